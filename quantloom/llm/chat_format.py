"""Chat formatting with schema fingerprints, in DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed strings of the template. None can stand in escaped text.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings that are escaped in texts; "<|" covers the template's own and any other of that style.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"


def fingerprint(paths: list[str]) -> str:
    """The hash of a layout: SHA-256 over its nested field paths, sorted, one a line; array elements add ``[]``."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``single``: (role, path) pairs, each one turn, in order.
    ``each``: (array path, role field, text field) of a list of messages, after ``single``.
    ``roles`` renames role names."""

    paths: tuple[str, ...]
    single: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
#: The layouts known by default; more can be given to canonical().
MAPPINGS = (
    Mapping(("messages[].content", "messages[].role"), each=("messages", "role", "content"), roles=ALIASES),
    Mapping(("messages[].content", "messages[].role", "system"), single=(("system", "system"),), each=("messages", "role", "content"), roles=ALIASES),
    Mapping(("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=ALIASES),
    Mapping(("conversations[].from", "conversations[].value", "system"), single=(("system", "system"),), each=("conversations", "from", "value"), roles=ALIASES),
    Mapping(("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("prompt", "response", "system"), single=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("question", "answer"), single=(("user", "question"), ("assistant", "answer"))),
    Mapping(("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), single=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output", "system"), single=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
)


def _paths(kind: T.DataType, at: Column, name: str = "") -> list[Column]:
    """For each leaf path under a typed column its name where it is present, else null.
    A field is present unless null; of an array of structs all fields are, if the array isn't null."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, at.getField(f.name), f"{name}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [F.when(at.isNotNull(), F.lit(f"{name}[].{f.name}")) for f in kind.elementType.fields]
    return [F.when(at.isNotNull(), F.lit(name + ("[]" if isinstance(kind, T.ArrayType) else "")))]


def layout_of(record: Column, kind: T.DataType) -> Column:
    """fingerprint() of each row's own layout, from the fields that aren't null."""
    return F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*_paths(kind, record)))), "\n"), 256)


def _at(kind: T.DataType, record: Column, path: str) -> Column | None:
    """A field as text; None if the record type lacks it. ``a+b``: those of them that aren't empty, in lines of their own."""
    parts = [record.getField(p).cast("string") for p in path.split("+") if p in kind.fieldNames()]
    if len(parts) < path.count("+") + 1:
        return None
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n") if len(parts) > 1 else F.coalesce(parts[0], F.lit(""))


def _turns(m: Mapping, record: Column, kind: T.StructType) -> Column | None:
    parts = []
    for role, path in m.single:
        if (text := _at(kind, record, path)) is None:
            return None
        parts.append(F.array(F.struct(F.lit(role).alias("role"), text.alias("text"))).cast(TURNS))
    if m.each:
        name, role, text = m.each
        if name not in kind.fieldNames() or not {role, text} <= set(kind[name].dataType.elementType.fieldNames()):
            return None
        named = lambda r: reduce(lambda c, kv: F.when(F.lower(r) == kv[0], F.lit(kv[1])).otherwise(c), m.roles.items(), r)
        parts.append(F.transform(F.coalesce(record.getField(name), F.array().cast(kind[name].dataType)), lambda x: F.struct(F.coalesce(named(x.getField(role)), F.lit("")).alias("role"), F.coalesce(x.getField(text).cast("string"), F.lit("")).alias("text"))).cast(TURNS))
    return F.concat(*parts)


def canonical(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` (fingerprint) and ``turns`` (array of role, text) for a struct column ``record``.

    The nested paths of a row's non-null fields are hashed and select a declarative
    mapping; a row whose layout no mapping has keeps its fingerprint and gets null turns,
    so unknown layouts can be counted and mapped. JSON text can be read with from_json()
    into a struct of all known fields first. Null texts and roles count as empty. A null record has the layout of no
    fields and null turns. Columns of the input named ``layout`` or ``turns`` are replaced, all others stay.
    """
    kind = df.schema[record].dataType
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        if (own := _turns(m, F.col(record), kind)) is not None:
            turns = F.when(F.col("layout") == fingerprint(list(m.paths)), own).otherwise(turns)
    return df.withColumn("layout", layout_of(F.col(record), kind)).withColumn("turns", turns)


def escape(c: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of each control
    string. The run of backslashes there is odd only where this put it, so it is reversible."""
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROLS, F.replace(c, F.lit("\\"), F.lit("\\\\")))


def unescape(c: Column) -> Column:
    return F.replace(reduce(lambda t, s: F.replace(t, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s)), CONTROLS, c), F.lit("\\\\"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    """As escape(); a line break, which ends the role, becomes ``<\\n>``."""
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n>"), F.lit("\n")))


def format_chats(df: DataFrame, key: str, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """One text per conversation with its loss mask: key, formatted, loss.

    Each turn is ``<|turn|>role``, a line break, its text, ``<|end|>`` and a line break,
    with control strings in role and text escaped. ``loss`` has the (start, length) in
    code points of every text of ``loss_role``, in order. Starts are running sums over the
    turns as rows, so the work is linear in the turns. Rows of one key, null included, are conversations of their own, told apart by a 64-bit hash of their turns, and
    repeated rows, which are counted before they are shuffled, come out as often as they went in. All is by key and hash, so there is
    one exchange, or none where the rows are dealt by key already. A
    conversation without turns, or with null ones, is the empty text with an empty mask. Null roles and
    texts inside count as empty. Other columns aren't kept; an empty table gives an empty one.
    """
    role, text = _escape_role(F.coalesce("turn.role", F.lit(""))), escape(F.coalesce("turn.text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    rows = df.select(F.col(key).alias("key"), F.col(turns).alias("turns")).withColumn("own", F.xxhash64("turns"))
    rows = rows.groupBy("key", "own").agg(F.first("turns").alias("turns"), F.count("*").cast("int").alias("times"))
    rows = rows.select("key", "own", "times", F.posexplode_outer("turns").alias("pos", "turn")).where("pos is null or turn is not null")
    rows = rows.select("key", "own", "times", "pos", F.col("turn.role").eqNullSafe(loss_role).alias("learn"), F.char_length(head).alias("before"), F.char_length(text).alias("length"), F.concat(head, text, F.lit(CLOSE)).alias("piece"))
    ends = F.sum(F.char_length("piece").cast("long")).over(Window.partitionBy("key", "own").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("start", ends - F.char_length("piece") + F.col("before"))
    grouped = rows.groupBy("key", "own").agg(F.first("times").alias("times"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece", "learn", "start", "length")))).alias("all"))
    return grouped.select(
        F.col("key").alias(key), F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"),
    ).drop("copy")


def read_back(df: DataFrame, key: str, formatted: str = "formatted", loss: str = "loss") -> DataFrame:
    """What format_chats() made, read again: key, formatted, turns, and loss_text, the unescaped text under the mask.

    Turns become rows with their places, and each span of the mask is looked up in the turn that
    it lies in by a window over both in order of their places; so the work is linear in the turns, as
    no text is gone through once a span. There is one exchange, or none where rows are dealt by key already. Repeated rows are counted, read once, and come out as often. A null text
    gives no turns and an empty loss_text; other columns aren't kept.
    """
    rows = df.select(F.col(key).alias("key"), F.col(formatted).alias("text"), F.col(loss).alias("spans")).withColumn("own", F.xxhash64("text", "spans"))
    rows = rows.groupBy("key", "own").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").cast("int").alias("times"))
    kind = "struct<pos:int,piece:string,at:bigint,span:int,length:int,text:string>"
    none = F.lit(None)
    pieces = F.coalesce(F.filter(F.split("text", "<\\|end\\|>\\n", -1), lambda p: p != ""), F.array().cast("array<string>"))
    # One array of all that becomes rows, the text once among them, so that a generator makes them and the text isn't copied.
    entries = F.concat(
        F.array(F.struct(none.alias("pos"), none.alias("piece"), none.alias("at"), none.alias("span"), none.alias("length"), "text").cast(kind)),
        F.transform(pieces, lambda p, i: F.struct(i.alias("pos"), p.alias("piece"), none.alias("at"), none.alias("span"), none.alias("length"), none.alias("text")).cast(kind)),
        F.transform(F.coalesce("spans", F.array().cast(df.schema[loss].dataType)), lambda s, i: F.struct(none.alias("pos"), none.alias("piece"), s["start"].alias("at"), i.alias("span"), s["length"].alias("length"), none.alias("text")).cast(kind)),
    )
    both = rows.select("key", "own", "times", F.explode(entries).alias("entry")).select("key", "own", "times", "entry.*")
    places = Window.partitionBy("key", "own").orderBy(F.col("pos").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("long") + len(CLOSE)).over(places), F.lit(0))
    both = both.withColumn("at", F.when(F.col("piece").isNotNull(), start).otherwise(F.col("at")))
    upto = Window.partitionBy("key", "own").orderBy(F.col("at").asc_nulls_first(), F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")), ignorenulls=True).over(upto)
    both = both.withColumn("held", F.when(F.col("span").isNotNull(), held))
    told = unescape(F.substring("held.piece", (F.col("at") - F.col("held.at") + 1).cast("int"), F.col("length").cast("int")))
    body = F.substring("piece", F.lit(len(OPEN) + 1), F.char_length("piece"))
    role = F.substring_index(body, "\n", 1)
    turn = F.struct(_unescape_role(role).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.char_length(body))).alias("text"))
    both = both.select("key", "own", "times", "text", F.when(F.col("piece").isNotNull(), F.struct("pos", turn.alias("turn"))).alias("turn"), F.when(F.col("span").isNotNull(), F.struct("span", told.alias("told"))).alias("under"))
    # The text is on one row; first() would copy it again for each other one.
    read = both.groupBy("key", "own").agg(F.get(F.collect_list("text"), 0).alias("text"), F.max("times").alias("times"), F.array_sort(F.collect_list("turn")).alias("turns"), F.array_sort(F.collect_list("under")).alias("under"))
    return read.select(F.col("key").alias(key), F.col("text").alias(formatted), F.transform("turns", lambda x: x["turn"]).alias("turns"), F.array_join(F.transform("under", lambda x: x["told"]), "").alias("loss_text"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
