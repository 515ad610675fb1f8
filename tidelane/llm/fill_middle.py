"""Fill-in-middle transformation with cuts found in a wavelet matrix (operator 12).

A text is cut after two of its units into prefix, middle and suffix, which are written in another order with sentinels
between them, so that a model that reads from left to right learns to fill a gap. Units are words with the white space
before them (white space at the end is one more unit), or lines.

The UTF-8 bytes of many texts at once become symbols: the kind of a byte (first of a character, later byte of one, white
space, line feed), and whether white space begins or ends behind it. A wavelet matrix over the symbols answers all that is
asked by ranks: a unit's end is one of a few symbols, so their ranks add up to the number of units before any place;
bisection on these sums finds both cuts of every text together; and characters are bytes less the rank of later bytes.
Texts are cut where they lie, with nothing shuffled, some megabytes of them at a time (a longer text alone). Rebuilding a
text from its output is a column expression.

Which texts are cut, where, and in which order follows from a hash of seed and doc_id alone, so a repeated task gives the
same rows. Sentinels cannot be mistaken: a text that holds one stays plain, and no sentinel can begin inside a piece and
end in the next, since each begins with the only ``<`` it has.

Defined cases: a null text is empty; an empty text is plain with 0 units; a null doc_id hashes like the text ``null``;
repeated rows give equal rows; cuts may fall together or at either end, so that pieces are empty; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import slices
from .shared import read_table
from .wavelet import WaveletMatrix

SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

# A symbol is twice the kind of a byte, and one more where the next byte changes between white space and the rest.
FIRST, LATER, SPACE, FEED = range(4)
KINDS = np.full(256, FIRST, np.uint8)
KINDS[0x80:0xC0] = LATER
KINDS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
KINDS[0x0A] = FEED
BITS = 3
LATER_BYTES = (2 * LATER, 2 * LATER + 1)
UNIT_ENDS = {"word": (2 * FIRST + 1, 2 * LATER + 1), "line": (2 * FEED, 2 * FEED + 1)}


def symbols(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of every byte; texts end at ``ends``, where a change is always seen."""
    kinds = KINDS[data]
    gap = kinds >= SPACE
    change = np.ones(len(data), np.uint8)
    change[:-1] = gap[:-1] != gap[1:]
    change[ends[ends > 0] - 1] = 1
    return kinds * 2 + change


def cut(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "word"):
    """Units, cuts after h1 and h2 modulo (units + 1) of them, smaller first, and the characters of prefix and middle, of the
    texts that lie in ``data`` between ``bounds``."""
    start, end = bounds[:-1], bounds[1:]
    marks = symbols(data, end)
    matrix, ends = WaveletMatrix(marks, BITS), UNIT_ENDS[unit]
    n = matrix.rank(ends, end) - matrix.rank(ends, start)
    some = end > start
    n[some] += ~np.isin(marks[end[some] - 1], ends)  # what follows the last end is one more unit
    a, b = h1 % (n + 1), h2 % (n + 1)
    first = matrix.locate(ends, start, end, np.minimum(a, b))
    second = matrix.locate(ends, start, end, np.maximum(a, b))
    later = [matrix.rank(LATER_BYTES, x) for x in (start, first, second)]
    return n, first, second, first - start - (later[1] - later[0]), second - first - (later[2] - later[1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its n + 1 bounds in them."""
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def as_strings(pieces: list, sizes: np.ndarray) -> pa.Array:
    """A string array from byte pieces; ``sizes`` has the bytes of each string."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces)))


def transform(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = "word", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    p, s, m = (x.encode() for x in sentinels)

    def cut_slice(keys, texts: pa.Array, h: list[np.ndarray]) -> pa.RecordBatch:
        data, bounds = text_bytes(texts)
        n, first, second, prefix, middle = cut(data, bounds, h[0], h[1], unit)
        marked = np.zeros(len(texts), bool)
        for mark in sentinels:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = (bounds[1:] == bounds[:-1]) | marked | (h[2] % 100 >= cut_percent)
        spm = h[3] % 100 < spm_percent
        view, pieces = memoryview(data), []
        for i, (a, b, c, d) in enumerate(zip(bounds[:-1].tolist(), first.tolist(), second.tolist(), bounds[1:].tolist())):
            if plain[i]:
                pieces.append(view[a:d])
            elif spm[i]:
                pieces += (s, view[c:d], p, view[a:b], m, view[b:c])
            else:
                pieces += (p, view[a:b], s, view[c:d], m, view[b:c])
        forms = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
        sizes = np.diff(bounds) + np.where(plain, 0, len(p) + len(s) + len(m))
        found = [keys, pa.array(n), pa.array(forms.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), as_strings(pieces, sizes)]
        return pa.RecordBatch.from_arrays(found, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            h = [batch.column(2 + i).to_numpy() for i in range(4)]
            for a, b in slices(texts):
                yield cut_slice(batch.column(0).slice(a, b - a), texts.slice(a, b - a), [x[a:b] for x in h])

    return docs.select(F.col("doc_id").cast("long"), "text", *hashes).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of."""
    p, s, m = map(F.lit, sentinels)
    part = lambda text, mark, i: F.split_part(text, mark, F.lit(i))
    middle, rest = part(output, m, 2), part(output, m, 1)
    psm = F.concat(part(part(rest, s, 1), p, 2), middle, part(rest, s, 2))
    spm = F.concat(part(rest, p, 2), middle, part(part(rest, p, 1), s, 2))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(read_table(spark, sf_dir, "documents"))
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(back).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
n AS (SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:n], '') AS z FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
