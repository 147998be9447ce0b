"""Fill-in-middle transformation of whole texts.

A text is a run of units, ``[A-Za-z]+`` or any other single code point.  One
``fullmatch`` of the repeated unit group keeps every repetition, so the ends of
that group give the number of units and both cut offsets without a loop over
the text.  The parts are then put in the order of the drawn form, between
markers; ``restored`` takes the text back from output and form alone.

A text's form and cuts are drawn from the digest of its id, so a row gives the
same output wherever and however often it runs.  All steps are maps: nothing is
shuffled, and a task holds one short run of texts at a time.

Defined results: a null text counts as empty; an empty text, and one that holds
a marker itself, stays as it is (form ``plain``); a row without an id is drawn
as if its id were an empty string; repeated rows repeat their result; an empty
table gives an empty result; other columns are not read, and those named like
output columns are replaced.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Per cent of texts that are cut, and of those that put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Repeated capture of a unit.
UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
BREAK = regex.compile(r"[^A-Za-z]")
#: Code points of texts handled at once; a longer text is alone.
CHUNK = 1 << 20


def unit_ends(text: str, most: int = CHUNK) -> np.ndarray:
    """End of every unit, by one match; the matcher holds some million units at most, so a longer text is matched
    in pieces that end behind a non-letter, where a unit always ends."""
    parts, at = [], 0
    while at < len(text) or not parts:
        stop = BREAK.search(text, at + most) if len(text) - at > most else None
        end = stop.end() if stop else len(text)
        parts.append(np.array(UNITS.fullmatch(text, at, end).ends(1), np.int64))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def cuts(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and the offsets where prefix and middle end."""
    ends = unit_ends(text)
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0


def rearranged(text: str, a: int, b: int, form: str) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned integers from the id's digest."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, a row per row of ``docs``."""
    h = draws(F.col(doc_id))
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for m in MARKERS:
        marked |= F.contains(whole, F.lit(m))
    form = F.when((whole == "") | marked | (h[2] % 100 >= CUT), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    source = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            rows = zip(*(batch.column(i) for i in range(1, 5)), strict=True)
            start, got, held = 0, [], 0
            for at, (t, h1, h2, f) in enumerate(rows, 1):
                whole, shape = t.as_py(), f.as_py()
                n, a, b = cuts(whole, h1.as_py(), h2.as_py())
                plain = shape == "plain"
                got.append((n, shape, None if plain else a, None if plain else b - a, rearranged(whole, a, b, shape)))
                held += len(whole)
                if held > CHUNK or at == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *columns],
                                                     names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    start, got, held = at, [], 0

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A text that was cut holds no marker, and no marker can arise where a part
    meets one, so the first place of each marker is the one that was put there.
    """
    second = F.instr(output, F.when(form == "psm", SUFFIX).otherwise(PREFIX))
    third = F.instr(output, F.lit(MIDDLE))
    one = F.substring(output, F.lit(len(PREFIX) + 1), second - len(PREFIX) - 1)
    two = F.substring(output, second + len(SUFFIX), third - second - len(SUFFIX))
    middle = F.substring(output, third + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
