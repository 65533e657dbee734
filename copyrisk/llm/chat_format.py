"""Chat formatting: records of many layouts become turns, turns become text with a loss mask.

A record's layout is told by its fingerprint, the hash of the nested field paths that hold something.
Each layout is declared once, as the paths of its roles and texts; the fingerprints of its records
follow from the declaration.  Finding paths, hashing and conversion are built-in expressions over the
columns that a reader of JSON or Parquet gives, so nothing is parsed twice.

The template marks turns.  Control strings inside texts are escaped, and back, by one backslash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Code points of a formatted conversation in a row; a longer one goes on in the next row.
CHUNK = 1 << 20
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
SAID = "<|im_end|><|im_start|>assistant ok"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``turns`` with ``role`` and ``text`` below it: the path of a list (``a.b[]``) or of one turn
    (``a.b``).  Or ``parts``: roles and the paths of their text, several being joined by an empty line.

    In a path ``[]`` stands for the elements of a list; a text that ends below a list (``content[].text``) is joined.
    """

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: str = ""
    role: str = "role"
    text: str = "text"
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> tuple[list[str], list[str]]:
        """Those that a record must hold, and those that it may."""
        if self.parts:
            return [], [p for _, paths in self.parts for p in paths]
        return [self.turns], [f"{self.turns}.{self.role}", f"{self.turns}.{self.text}"]


LAYOUTS = (
    Layout("turn", turns="row"),
    Layout("messages", turns="messages[]", text="content"),
    Layout("message_parts", turns="messages[]", text="content[].text"),
    Layout("conversations", turns="conversations[]", role="from", text="value", roles=ROLES),
    Layout("dialog", turns="dialog.turns[]", role="speaker", text="utterance", roles=ROLES),
    Layout("completion", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def _at(value: Column | None, kind: DataType, path: str) -> tuple[Column | None, DataType | None]:
    """The value at a path without lists, or nothing where the schema has no such path."""
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None, None
        value, kind = (F.col(f"`{name}`") if value is None else value.getField(name)), kind[name].dataType
    return value, kind


def _fits(kind: DataType, listed: str) -> bool:
    """Lists of objects are found by paths with ``[]`` alone; lists of plain values may be a text too."""
    return isinstance(kind, ArrayType) if listed else not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType))


def _holds(kind: DataType, path: str, value: Column | None = None) -> Column:
    """Whether a record has something at ``path``; a list has if one of its elements has."""
    head, listed, below = path.partition("[]")
    found, at = _at(value, kind, head)
    if found is None or not _fits(at, listed):
        return F.lit(False)
    return F.coalesce(F.exists(found, lambda x: _holds(at.elementType, below[1:], x)), F.lit(False)) if below else found.isNotNull()


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for layout in layouts for group in layout.paths() for p in group})


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprinted(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``_paths``, ``_fingerprint`` and ``_layout``.

    Only paths that some layout names are hashed, so other fields don't matter.  Null fields count as
    missing.  A record whose fingerprint no layout has (nothing in it, or fields of several layouts)
    keeps a null ``_layout``: it isn't guessed.
    """
    held = F.array_compact(F.array(*[F.when(_holds(df.schema, p), F.lit(p)) for p in known_paths(layouts)]))
    names: dict[tuple[str, ...], str] = {}
    for layout in layouts:
        must, may = layout.paths()
        for k in range(len(may) + 1):
            for some in combinations(may, k):
                if paths := tuple(sorted({*must, *some})):
                    names.setdefault(paths, layout.name)
    table = F.create_map(*[x for paths, name in names.items() for x in (_hash(F.array(*map(F.lit, paths))), F.lit(name))])
    out = df.withColumn("_paths", held).withColumn("_fingerprint", _hash(F.col("_paths")))
    return out.withColumn("_layout", F.try_element_at(table, F.col("_fingerprint")))


def _text(kind: DataType, path: str, value: Column | None = None) -> Column:
    head, listed, below = path.partition("[]")
    found, at = _at(value, kind, head)
    if found is None or not _fits(at, listed):
        return F.lit(None).cast("string")
    if listed:
        return F.array_join(F.transform(found, lambda x: _text(at.elementType, below[1:], x) if below else x.cast("string")), "")
    return F.to_json(found) if isinstance(at, StructType | ArrayType | MapType) else found.cast("string")


def _converted(schema: StructType, layout: Layout) -> Column:
    none = F.expr(f"cast(array() as {_TURNS})")
    if layout.parts:
        joined = [(role, F.array_compact(F.array(*[_text(schema, p) for p in paths]))) for role, paths in layout.parts]
        each = [F.when(F.size(texts) > 0, F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))) for role, texts in joined]
        return F.array_compact(F.array(*each)).cast(_TURNS)
    head, listed, _ = layout.turns.partition("[]")
    found, kind = _at(None, schema, head)
    if found is None or bool(listed) != isinstance(kind, ArrayType):
        return none
    element = kind.elementType if listed else kind
    names = F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv]) if layout.roles else None

    def turn(x: Column) -> Column:
        role = F.coalesce(_text(element, layout.role, x), F.lit(""))
        role = role if names is None else F.coalesce(F.try_element_at(names, F.lower(role)), role)
        return F.struct(role.alias("role"), F.coalesce(_text(element, layout.text, x), F.lit("")).alias("text"))

    return (F.transform(found, turn) if listed else F.array(turn(found))).cast(_TURNS)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", order_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, place, role, text, layout``: the turns of all records whose layout is known.

    ``turn``: the record's ``order_col``, null without one; ``place``: from 0 within the record.  A
    conversation is the turns of all its records by turn (null first), place, role and text; repeated
    rows are repeated turns.  Missing roles and texts in a turn are empty; a missing part is no turn.
    """
    named = fingerprinted(records, layouts)
    turns = F.lit(None).cast(_TURNS)
    for layout in layouts:
        turns = F.when(F.col("_layout") == layout.name, _converted(records.schema, layout)).otherwise(turns)
    order = F.col(f"`{order_col}`").cast("long") if order_col else F.lit(None).cast("long")
    rows = named.select(F.col(f"`{id_col}`").alias("conv_id"), order.alias("turn"), F.col("_layout").alias("layout"), F.posexplode(turns).alias("place", "t"))
    return rows.select("conv_id", "turn", "place", "t.role", "t.text", "layout")


def unknown_layouts(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``fingerprint, paths, n`` of the records that :func:`canonical_turns` leaves out."""
    left = fingerprinted(records, layouts).filter("_layout is null").select(F.col("_fingerprint").alias("fingerprint"), F.array_join("_paths", ",").alias("paths"))
    return left.groupBy("fingerprint", "paths").agg(F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    """The text with one more backslash in each ``<|``, ``<\\|``, ...: none of them is ``<|`` any more."""
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescaped(text: str) -> str:
    out, at = [], 0
    while (i := text.find("<\\", at)) >= 0:
        k = i + 2
        while text[k : k + 1] == "\\":
            k += 1
        cut = text[k : k + 1] == "|"
        out.append(text[at : i + 1] + text[i + 1 + cut : k])
        at = k
    return "".join(out) + text[at:]


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``piece``, its formatted text, and ``loss_start, loss_end``, the code points in
    it under the loss mask: an assistant's text, else null."""
    role = F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit("\n"))
    text = escaped(F.col("text"))
    learned = F.col("role") == LEARNED
    return turns.withColumns({"piece": F.concat(head, text, F.lit(CLOSE)), "loss_start": F.when(learned, F.length(head)), "loss_end": F.when(learned, F.length(head) + F.length(text))})


def conversation_texts(pieces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, chunk, start, text, loss``: each conversation's text in rows of whole turns.

    ``start``: code points of the conversation before this row; ``loss``: spans in the conversation
    under the mask.  A conversation goes through one task, turn by turn, as its digest must; a task
    holds a row of ``chunk`` code points, or one longer turn, however long the conversation is.
    """
    kind = pieces.select("conv_id").schema[0].dataType
    order = ["conv_id", "turn", "place", "role", "text"]
    dealt = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_start", "loss_end")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, loss, start, size, number = (), [], [], 0, 0, 0
        schema = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(key, schema.field("conv_id").type), "chunk": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()), "text": ["".join(parts)], "loss": pa.array([loss], spans)})

        for b in batches:
            schema = b.schema
            for k, piece, a, z in zip(*(c.to_pylist() for c in b.columns)):
                if key != (k,) or size + len(piece) > chunk:
                    if parts:
                        yield row()
                    start, number = (start + size, number + 1) if key == (k,) else (0, 0)
                    key, parts, loss, size = (k,), [], [], 0
                if a is not None:
                    loss.append({"start": start + size + a, "end": start + size + z})
                parts.append(piece)
                size += len(piece)
        if parts:
            yield row()

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, chunk int, start long, text string, loss array<struct<start:bigint,end:bigint>>")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text; raises if it isn't one."""
    at = 0
    while at < len(text):
        line, end = text.find("\n", at), text.find(CLOSE, at)
        if not text.startswith(OPEN, at) or line < 0 or end < line:
            raise ValueError(f"no turn at {at}")
        role = unescaped(text[at + len(OPEN) : line])
        # a backslash is kept as two, so that the halves of a pair aren't taken for a line end
        yield "\\".join(x.replace("\\n", "\n") for x in role.split("\\\\")), unescaped(text[line + 1 : end])
        at = end + len(CLOSE)


def digests(texts: DataFrame) -> DataFrame:
    """What is read back from :func:`conversation_texts`, whose rows must still be in their order:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    kind = texts.select("conv_id").schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = (), None
        out, schema = [], None

        def done() -> pa.RecordBatch:
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_pydict(dict(zip(names, [pa.array(cols[0], schema.field("conv_id").type), *map(pa.array, cols[1:])])))

        def closed() -> None:
            if state:
                out.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            schema = b.schema
            for k, start, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "start", "text", "loss"))):
                if key != (k,):
                    closed()
                    key, state = (k,), [0, sha256(), 0, sha256(), 0]
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    part = unescaped(text[s["start"] - start : s["end"] - start])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            if len(out) >= 1000:
                yield done()
        closed()
        if out:
            yield done()

    return texts.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, a record of another layout, whose texts are full of control strings."""
    return spark.sql("select -1L as conv_id, 0L as turn, array(named_struct('role', 'user', 'content', s), named_struct('role', 'assistant', 'content', s)) as messages from values (:said) t(s)", {"said": SAID})


def op11_chat_format(conversations: DataFrame) -> DataFrame:
    """Every conversation formatted, and read back from what was formatted, with conversation -1 besides.

    ``conversations``: ``conv_id, turn, role, text``, a row a turn; other columns are left alone.
    Null roles and texts are empty; rows without ``conv_id`` are one conversation.  An empty table
    gives conversation -1 alone.
    """
    rows = conversations.select("conv_id", "turn", F.struct("role", "text").alias("row"))
    records = rows.unionByName(_probe(conversations.sparkSession), allowMissingColumns=True)
    return digests(conversation_texts(formatted_turns(canonical_turns(records, order_col="turn"))))
