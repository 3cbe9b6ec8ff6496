"""Raw records that fail to parse: a minimum-cost error parse of delimited lines and FASTQ records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of each kind of record.
FORMS = {"bed": {"delimiter": "\t", "fields": 8, "quotes": True}, "fastq": {"delimiter": "\n", "fields": 4, "quotes": False}}
CONFIDENCE = ["high", "medium", "low"]
STRANDS = ["+", "-", "."]

OTHER, QUOTE, DELIMITER = 0, 1, 2
BEGIN, PLAIN, QUOTED, CLOSED = 0, 1, 2, 3  # where the parse stands: at a field's begin, in it, in its quotes, after them
#: A quote edit costs more than any number of delimiter edits, so a record needs one only if its quoting is broken.
Q, D = 1 << 32, 1

#: Events of which the choices are kept at once when edits are traced.
TRACED = 4096

#: By event: (from, to, fields begun, cost, edit). A delimiter that is inserted to mend quoting is a quote edit.
MOVES = {
    OTHER: [
        (BEGIN, PLAIN, 0, 0, ""), (PLAIN, PLAIN, 0, 0, ""), (QUOTED, QUOTED, 0, 0, ""),
        (CLOSED, QUOTED, 0, Q, "insert quote"), (CLOSED, PLAIN, 1, Q, "insert delimiter after quote"),
    ],
    QUOTE: [
        (BEGIN, QUOTED, 0, 0, ""), (BEGIN, BEGIN, 0, Q, "delete quote"), (PLAIN, PLAIN, 0, Q, "delete quote"),
        (QUOTED, CLOSED, 0, 0, ""), (QUOTED, QUOTED, 0, Q, "delete quote"),
        (CLOSED, QUOTED, 0, 0, ""), (CLOSED, CLOSED, 0, Q, "delete quote"),
    ],
    DELIMITER: [
        (BEGIN, BEGIN, 1, 0, ""), (BEGIN, BEGIN, 0, D, "delete delimiter"), (PLAIN, BEGIN, 1, 0, ""), (PLAIN, PLAIN, 0, D, "delete delimiter"),
        (CLOSED, BEGIN, 1, 0, ""), (CLOSED, CLOSED, 0, D, "delete delimiter"),
        (QUOTED, QUOTED, 0, 0, ""), (QUOTED, BEGIN, 1, Q, "insert quote"),
    ],
}


def _events(raw: pa.Array, delimiter: str, quotes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-null records: events in a row (a run of other bytes is one), their byte offsets, and where each record's begin."""
    raw = raw.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = np.where(data == ord(delimiter), DELIMITER, np.where((data == ord('"')) & quotes, QUOTE, OTHER)).astype(np.int8)
    own = np.repeat(np.arange(len(raw)), np.diff(ends))
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] != OTHER) | (kind[:-1] != OTHER) | (own[1:] != own[:-1])
    at = np.flatnonzero(keep)
    first = np.searchsorted(own[at], np.arange(len(raw) + 1))
    return kind[at], at - ends[own[at]], first


def parse_costs(kind: np.ndarray, first: np.ndarray, fields: int, trace: bool = False):
    """Least cost of making each record well-formed (quote edits times Q, plus delimiter edits).

    The state is where the parse stands and how many fields are begun, at most `fields`; delimiters that are missing
    are inserted at the end. With trace, also the edits of each record: lists of (event, edit).
    """
    n, lengths = len(first) - 1, np.diff(first)
    order = np.argsort(lengths, kind="stable")
    steps = int(lengths.max(initial=0))

    def advance(cost: np.ndarray, lo: int, hi: int, back: list[np.ndarray] | None = None) -> None:
        for step in range(lo, hi):
            rows = order[np.searchsorted(lengths[order], step, side="right") :]
            now = kind[first[rows] + step]
            chosen = np.full((n if back is not None else 0, 4, fields), -1, np.int8)
            for event, moves in MOVES.items():
                some = rows[now == event]
                if not len(some):
                    continue
                old, new = cost[some], np.full((len(some), 4, fields), 1 << 60, np.int64)
                pick = np.full(new.shape, -1, np.int8)
                for i, (a, b, begun, price, _) in enumerate(moves):
                    offer = old[:, a, : fields - begun] + price
                    target, mark = new[:, b, begun:], pick[:, b, begun:]
                    mark[offer < target] = i
                    np.minimum(target, offer, out=target)
                cost[some] = new
                if back is not None:
                    chosen[some] = pick
            if back is not None:
                back.append(chosen)

    cost = np.full((n, 4, fields), 1 << 60, np.int64)
    cost[:, BEGIN, 0] = 0
    marks = []
    for lo in range(0, steps, TRACED):
        if trace:
            marks.append(cost.copy())
        advance(cost, lo, min(lo + TRACED, steps))
    final = cost + (fields - 1 - np.arange(fields)) * D
    final[:, QUOTED] += Q
    flat = final.reshape(n, -1)
    least = flat.min(axis=1)
    if not trace:
        return least
    at = [divmod(int(x), fields) for x in flat.argmin(axis=1)]
    edits = [[(-1, "insert quote")] * (state == QUOTED) + [(-1, "insert delimiter")] * (fields - 1 - have) for state, have in at]
    for lo in reversed(range(0, steps, TRACED)):  # the choices of one stretch are made again from its mark
        back: list[np.ndarray] = []
        advance(marks.pop(), lo, min(lo + TRACED, steps), back)
        for row in np.flatnonzero(lengths > lo):
            state, have = at[row]
            for step in range(min(lo + TRACED, int(lengths[row])) - 1, lo - 1, -1):
                a, _, begun, _, edit = MOVES[kind[first[row] + step]][back[step - lo][row, state, have]]
                state, have = a, have - begun
                if edit:
                    edits[row].append((step, edit))
            at[row] = state, have
    return least, [e[::-1] for e in edits]


def _without_end(raw: str, form: dict) -> str:
    """A record without the line end of its last line; where fields are lines, one that parts the last two stays."""
    if form["delimiter"] == "\n" and raw.endswith("\n") and raw.count("\n") < form["fields"]:
        return raw
    return re.sub(r"(\r\n|\n|\r)\Z", "", raw)


def _fields(raw: str, delimiter: str, quotes: bool) -> list[str]:
    """Fields of a well-formed record."""
    if quotes and '"' in raw:
        found = re.findall(f'("(?:[^"]|"")*"|[^{delimiter}]*)(?:{delimiter}|$)', raw + delimiter)[: FORMS["bed"]["fields"]]
        return [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in found]
    return [x.removesuffix("\r") for x in raw.split(delimiter)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    for b in batches:
        raws, forms = b.column("raw").to_pylist(), b.column("fmt").to_pylist()
        quote_edits, delimiter_edits, edits, fields = ([None] * b.num_rows for _ in range(4))
        for fmt, form in FORMS.items():
            rows = [i for i, (f, r) in enumerate(zip(forms, raws)) if f == fmt and r is not None]
            if not rows:
                continue
            texts = [_without_end(raws[i], form) for i in rows]
            kind, at, first = _events(pa.array(texts, pa.large_string()), form["delimiter"], form["quotes"])
            cost = parse_costs(kind, first, form["fields"])
            for i, c, text in zip(rows, cost.tolist(), texts):
                quote_edits[i], delimiter_edits[i] = c // Q, c % Q
                if not c:
                    fields[i] = _fields(text, form["delimiter"], form["quotes"])
            bad = np.flatnonzero(cost)
            for some in np.array_split(bad, -(-len(bad) // 256)) if len(bad) else []:  # the trace keeps every step of its records
                size = first[some + 1] - first[some]
                own = np.repeat(first[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                _, traced = parse_costs(kind[own], np.append(0, np.cumsum(size)), form["fields"], trace=True)
                for j, made in zip(some, traced):
                    edits[rows[j]] = [f"{edit} at {at[first[j] + step]}" if step >= 0 else f"{edit} at end" for step, edit in made]
        yield pa.RecordBatch.from_arrays(
            [b.column("raw_id"), b.column("fmt"), *(pa.array(x, t) for x, t in zip((quote_edits, delimiter_edits, edits, fields), types))],
            ["raw_id", "fmt", "quote_edits", "delimiter_edits", "edits", "fields"],
        )


def _digits(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def _less(a: Column, b: Column) -> Column:
    """Whether a number written in digits is less than another, of any length."""
    a, b = F.regexp_replace(a, "^0+", ""), F.regexp_replace(b, "^0+", "")
    return (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a < b))


def _reason() -> Column:
    """The first reason that applies to a parsed record; null if it is valid."""
    f = [F.get("fields", F.lit(i)) for i in range(8)]
    score = _digits(f[4]) & (F.length(F.regexp_replace(f[4], "^0+", "")) <= 4) & (F.try_to_number(F.lpad(F.regexp_replace(f[4], "^0+(?=.)", ""), 5, "0"), F.lit("00000")) <= 1000)
    bed = (
        F.when(F.col("quote_edits") > 0, "quoting")
        .when(F.coalesce(F.col("delimiter_edits") != 0, F.lit(True)), "columns")
        .when(~(_digits(f[1]) & _digits(f[2]) & _less(f[1], f[2])), "interval")
        .when(f[3] == "", "family")
        .when(~F.coalesce(score, F.lit(False)), "score")
        .when(~f[5].isin(STRANDS), "strand")
        .when(~f[6].isin(CONFIDENCE), "confidence")
    )
    fastq = (
        F.when(F.coalesce(F.col("delimiter_edits") != 0, F.lit(True)), "lines")
        .when(~f[0].rlike(r"^@\s*[^\s]"), "header")
        .when(~f[2].startswith("+"), "separator")
        .when(~f[1].rlike("^[ACGTNacgtn]+$"), "base")
        .when(F.length(f[1]) != F.length(f[3]), "length")
    )
    return F.when(F.col("fmt") == "bed", bed).when(F.col("fmt") == "fastq", fastq).otherwise("format")


def parse_records(df: DataFrame) -> DataFrame:
    """Parses raw records (raw_id, fmt, raw): (raw_id, fmt, fields, reason, quote_edits, delimiter_edits, edits).

    A record whose least parse cost is zero and whose fields have valid types has a null reason; `fields` has the
    fields of each record of cost zero. Else `reason` is the first that applies, and `edits` the quote and delimiter
    edits of a cheapest parse with their byte offsets. One line end at the end of a line is not part of it. A null
    record has the first structural reason of its format (`columns` or `lines`); a null or other format gives the
    reason `format`; an empty table an empty result. Other columns are not read.

    Records are independent: no shuffle; a task parses a batch at once, one dynamic-programming step over all of
    its records per event, events being quotes, delimiters and the runs of text between.
    """
    schema = "raw_id bigint, fmt string, quote_edits bigint, delimiter_edits bigint, edits array<string>, fields array<string>"
    parsed = df.select("raw_id", "fmt", "raw").mapInArrow(_parse, schema)
    return parsed.select("raw_id", "fmt", "fields", _reason().alias("reason"), "quote_edits", "delimiter_edits", "edits")


def bad_records(parsed: DataFrame) -> DataFrame:
    """The records that are not valid: (raw_id, reason)."""
    return parsed.where("reason is not null").select("raw_id", "reason")


def valid_arrays(parsed: DataFrame) -> DataFrame:
    """Rows of the valid arrays.bed records; a coordinate beyond bigint is null."""
    f = [F.get("fields", F.lit(i)) for i in range(8)]
    return parsed.where("reason is null and fmt = 'bed'").select(
        "raw_id", f[0].alias("chrom"), f[1].try_cast("bigint").alias("start_bp"), f[2].try_cast("bigint").alias("end_bp"), f[3].alias("family_id"),
        f[4].try_cast("int").alias("score"), f[5].alias("strand"), f[6].alias("confidence"), f[7].alias("warning"),
    )


def valid_reads(parsed: DataFrame) -> DataFrame:
    """Rows of the valid FASTQ records: (raw_id, id, sequence, quality, description)."""
    f = [F.get("fields", F.lit(i)) for i in range(4)]
    description = F.btrim(F.substr(f[0], F.lit(2)))
    return parsed.where("reason is null and fmt = 'fastq'").select(
        "raw_id", F.split(F.split(description, r"\s+")[0], ";")[0].alias("id"), F.upper(f[1]).alias("sequence"), f[3].alias("quality"), description.alias("description")
    )
