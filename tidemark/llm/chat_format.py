"""Operator 11: chat formatting with a black-box template, located by incremental rendering.

A template is any function from a list of (role, text) to one string. Successive prefixes of a conversation are rendered;
where each output starts with the one before, what was added is the new turn's span. Two renderings with other texts in
the last turn tell the header and the footer of that span from its text. A template whose output of a prefix is no longer
the start of the next one rewrites history: it is found out, and its texts are located in the final output instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranking import positions_within
from .common import field, stored, text_or_empty

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: A turn's part of the output, and where its text lies in that part (None: not located, or of a role without loss).
Piece = tuple[str, int | None, int | None]

#: Turns of a block, and turns before it that are rendered with it.
BLOCK, CONTEXT = 32, 8
#: Two texts that differ in their first and last character.
PROBES = ("a", "b")
#: Rows, and characters, at which a task hands its output on.
ROWS, CHARS = 5_000, 1 << 24
START, END = "<|im_start|>", "<|im_end|>"
APPENDED, REWRITTEN, REFUSED = "appended", "rewritten", "refused"


# The built-in template and its way back


def escaped(text: str) -> str:
    """No control string is left: a bar after "<" and any backslashes gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def chatml(turns: list[Turn]) -> str:
    """Turns between control strings. Texts are escaped; a role, which ends at the line's end, keeps its own line ends as \\n."""
    role = lambda r: escaped(r.replace("\\", "\\\\").replace("\n", "\\n"))
    return "".join(f"{START}{role(r)}\n{escaped(t)}{END}\n" for r, t in turns)


def read_chatml(parts: Iterable[str]) -> Iterator[Turn]:
    """Turns of chatml's output, which may come in any parts; holds one turn at a time."""
    held, mark = "", f"{END}\n"
    for part in parts:
        searched, held = max(0, len(held) - len(mark)), held + part
        while (end := held.find(mark, searched)) >= 0:
            role, text = held[len(START) : end].split("\n", 1)
            back = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
            yield back, unescaped(text)
            held, searched = held[end + len(mark) :], 0


# Locating turns


def shared(a: str, b: str, at: int = 0) -> int:
    """Length of the common start of a and b, which agree up to `at`."""
    low, high = at, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_end(a: str, b: str, most: int) -> int:
    low, high = 0, min(len(a), len(b), most)
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def text_span(render: Template, turns: list[Turn], i: int, now: str, at: int = 0) -> tuple[int, int] | None:
    """Where turn i's text lies in `now`, the output of turns: what two renderings with other texts there do not share.
    None where the template leaves the text out, or changes more than it with the text."""
    a, b = (render([*turns[:i], (turns[i][0], probe), *turns[i + 1 :]]) for probe in PROBES)
    head = shared(a, b, at if a[:at] == b[:at] else 0)
    tail = shared_end(a, b, min(len(a), len(b)) - head)
    whole = a != b and len(now) >= head + tail and now.startswith(a[:head]) and now.endswith(a[len(a) - tail :])
    return (head, len(now) - tail) if whole else None


def appended(render: Template, turns: list[Turn], loss_roles: frozenset[str], known: int = 0) -> list[Piece] | None:
    """Pieces of turns from `known` on; None once an output does not start with the one before."""
    before, out = render(turns[:known]) if known else "", []
    for i in range(known, len(turns)):
        prefix = turns[: i + 1]
        now = render(prefix)
        if not now.startswith(before):
            return None
        span = text_span(render, prefix, i, now, len(before)) if turns[i][0] in loss_roles else None
        if turns[i][0] in loss_roles and (span is None or span[0] < len(before)):
            return None
        out.append((now[len(before) :], *(x - len(before) for x in span)) if span else (now[len(before) :], None, None))
        before = now
    return out


def rewritten(render: Template, turns: list[Turn], loss_roles: frozenset[str]) -> list[Piece]:
    """Pieces of the final output. One ends where its turn's text ends, the last one at the output's end; a text that the
    output leaves out, or has before an earlier turn's, has an empty piece without a span."""
    final, out, at = render(turns), [], 0
    for i, (role, _) in enumerate(turns):
        span = text_span(render, turns, i, final)
        if span is None or span[0] < at:
            out.append(("", None, None))
            continue
        out.append((final[at : span[1]], *((span[0] - at, span[1] - at) if role in loss_roles else (None, None))))
        at = span[1]
    if out:
        out[-1] = (out[-1][0] + final[at:], *out[-1][1:])
    return out


def located(render: Template, turns: list[Turn], loss_roles: frozenset[str]) -> tuple[str, list[Piece]]:
    """Status and pieces of a whole conversation. A template that raises refuses it: its pieces are empty."""
    try:
        found = appended(render, turns, loss_roles)
        return (APPENDED, found) if found is not None else (REWRITTEN, rewritten(render, turns, loss_roles))
    except Exception:  # whatever the template raises
        return REFUSED, [("", None, None)] * len(turns)


# On Spark


def record_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)


def format_chats(
    chats: DataFrame, render: Template = chatml, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_roles: Iterable[str] = ("assistant",), block: int | None = BLOCK, context: int = CONTEXT,
) -> DataFrame:
    """One row per turn: id, turn, position (from 0), role, piece, loss_start, loss_end, status. A conversation's pieces in
    order of position are its formatted text; the text of a turn whose role has loss lies at [loss_start, loss_end) of
    its piece, in code points, and all else is outside the loss.

    Turns go by turn_col, nulls last, then by role and text, so repeated rows and equal turns have one order. Null roles
    and texts are empty; null ids form one conversation; an empty table gives no rows; other columns are not read.
    status: 'appended' if every output starts with the one before it; 'rewritten' if the template changes what it gave
    before (pieces are then those of the final output, and a text that it leaves out has none); 'refused' if it raises
    (pieces are empty).

    Rendering all prefixes takes time that grows with the square of the turns, so a conversation is cut into blocks of
    `block` turns, rendered behind the `context` turns before them: work and memory of a task are bounded, and a
    conversation that holds most rows is dealt over the cluster. Each block also gives the turn before it, which the
    block before gave with more turns ahead; where the two differ, where a block's outputs do not grow by appending, or
    where the template raises, that conversation is rendered whole, in one task. So a template may look at up to
    `context` turns before, or count or look at all; one that changes older output only once more than `block` turns lie
    behind needs block=None, which renders every conversation whole.
    """
    loss = frozenset(loss_roles)
    kinds = {f.name: f.dataType for f in chats.schema}
    rows = chats.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    placed = stored(positions_within(rows, ["conv"], [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")], "position"))
    made = T.StructType([
        T.StructField("conv", kinds[id_col]), T.StructField("turn", kinds[turn_col]), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("piece", T.StringType()),
        T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("status", T.StringType()), T.StructField("seam", T.BooleanType()),
    ])
    n = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blockwise(key, turns, known):
        """The turns after the known ones, and the last known one again."""
        if known == len(turns):  # the conversation ends with the block before
            return known, APPENDED, []
        again = max(known - 1, 0)
        try:
            found = appended(render, turns, loss, again)
        except Exception:  # whatever the template raises
            found = None
        return again, REWRITTEN if found is None else APPENDED, found or [("", None, None)] * (len(turns) - again)

    def whole(key, turns, known):
        return 0, *located(render, turns, loss)

    def rendered(df: DataFrame, keys: list[str], each: Callable) -> DataFrame:
        def run(batches):
            out, size = [], 0
            flow = (r for batch in batches for r in batch.to_pylist())
            for key, group in groupby(flow, key=lambda r: tuple(r[k] for k in keys)):
                held = list(group)
                first = key[1] * block if len(key) > 1 else 0
                again, status, pieces = each(key, [(r["role"], r["text"]) for r in held], sum(r["position"] < first for r in held))
                for r, (piece, start, end) in zip(held[again:] if pieces else [], pieces, strict=True):
                    out.append((r["conv"], r["turn"], r["position"], r["role"], piece, start, end, status, r["position"] < first))
                    size += len(piece)
                if len(out) >= ROWS or size >= CHARS:
                    yield record_batch(out, made)
                    out, size = [], 0
            if out:
                yield record_batch(out, made)

        dealt = df.repartition(n, *keys).sortWithinPartitions(*keys, "position")
        return dealt.select("position", "turn", "role", "text", *keys).mapInArrow(run, made)

    if block:
        own, place = F.floor(F.col("position") / block), F.col("position") % block
        # the last turns of a block are also the next one's context
        into = F.when(place >= block - context, F.array(own, own + 1)).otherwise(F.array(own))
        drawn = stored(rendered(placed.withColumn("block", F.explode(into)), ["conv", "block"], blockwise))
        edges = drawn.where(F.col("position") % block == block - 1).groupBy("conv", "position").agg(F.count_distinct(F.struct(F.xxhash64("piece"), F.length("piece"), F.coalesce("loss_start", F.lit(-1)), F.coalesce("loss_end", F.lit(-1)))).alias("n"))
        odd = stored(drawn.where(F.col("status") != APPENDED).select("conv").unionAll(edges.where("n > 1").select("conv")).distinct().withColumnRenamed("conv", "_odd"))
        same = F.col("conv").eqNullSafe(F.col("_odd"))
        done = drawn.where("NOT seam")
        if not odd.isEmpty():
            done = done.join(odd, same, "left_anti").unionAll(rendered(placed.join(odd, same, "left_semi"), ["conv"], whole))
    else:
        done = rendered(placed, ["conv"], whole)
    return done.select(F.col("conv").alias(id_col), F.col("turn").alias(turn_col), "position", F.col("role").alias(role_col), "piece", "loss_start", "loss_end", "status")


def read_back(formatted: DataFrame, read: Callable[[Iterable[str]], Iterator[Turn]] = read_chatml, unescape: Callable[[str], str] = unescaped, *, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, from the pieces alone: id, n_turns, turns_sha256 (of role, line end, text, line end for
    each turn read), loss_chars and loss_sha256 (of the unescaped text under the loss), formatted_chars. Pieces are sorted
    by Spark and stream through, so a task holds one turn of one conversation."""
    out = T.StructType([field(formatted, id_col), *[T.StructField(c, t) for c, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]])
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        made = []
        flow = (r for batch in batches for r in batch.to_pylist())
        for conv, held in groupby(flow, key=lambda r: r["conv"]):
            loss, turns, sizes = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

            def pieces(held=held, loss=loss, sizes=sizes):
                for r in held:
                    if r["loss_start"] is not None:
                        text = unescape(r["piece"][r["loss_start"] : r["loss_end"]])
                        loss.update(text.encode())
                        sizes[1] += len(text)
                    sizes[2] += len(r["piece"])
                    yield r["piece"]

            for role, text in read(pieces()):
                turns.update(f"{role}\n{text}\n".encode())
                sizes[0] += 1
            made.append((conv, sizes[0], turns.hexdigest(), sizes[1], loss.hexdigest(), sizes[2]))
            if len(made) >= ROWS:
                yield record_batch(made, out)
                made.clear()
        if made:
            yield record_batch(made, out)

    rows = formatted.select(F.col(id_col).alias("conv"), "position", "piece", "loss_start", "loss_end")
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "position").mapInArrow(run, out)
