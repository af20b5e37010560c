"""Documents turned into prefix, suffix and middle, so that a model learns to fill in.

The work is DuckDB SQL inside ``mapInArrow``: slices of about a megabyte of text of each Arrow batch are registered as a table; one
statement cuts the texts into tokens by pattern, draws the cuts and the form from a SHA-256 of seed and id,
joins the token ranges to strings and gives Arrow back.  No row is touched in Python, nothing is
shuffled, and the draw depends on a row's id alone, so that a lost task gives the same rows again.

A token is a word with the white space before it, or white space at the end; tokens are code points as written, so the
output holds the text's own characters and :func:`restored` gives the text back exactly.

Defined results: a null text is empty and plain; texts that hold a mark stay plain; a null id is drawn
by the seed alone; repeated rows get the same form; an empty table gives an empty result; texts of any length are cut whole.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM_SHARE = 42, 50, 80
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: DuckDB's memory in a task; a slice of text is about a megabyte unless a single text is longer.
MEMORY = "1GB"
SLICE = 1 << 20
_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

_SQL = """
WITH drawn AS (
    SELECT place, text, sha256($seed || ':' || coalesce(CAST(id AS VARCHAR), '')) AS h, regexp_extract_all(text, $token) AS units FROM slice
), hashed AS (
    SELECT place, text, units, len(units) AS n,
           list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS UBIGINT)) AS r
    FROM drawn
), cut AS (
    SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR r[3] % 100 >= $rate THEN 'plain'
                WHEN r[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT place, text, n, form,
           CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
           CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle,
           CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix
    FROM cut
)
SELECT place, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
       CASE form WHEN 'plain' THEN text
                 WHEN 'psm' THEN concat($p, prefix, $s, suffix, $m, middle)
                 ELSE concat($s, suffix, $p, prefix, $m, middle) END AS output
FROM parts ORDER BY place
"""


def slices(texts: pa.Array, size: int = SLICE) -> list[tuple[int, int]]:
    """(from, to) of runs of about ``size`` bytes of text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True)) if len(texts) else []


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    spm_share: int = SPM_SHARE,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns ``id``, ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` of 100 texts are transformed, ``spm_share`` of 100 of them with the suffix first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fixed = {"seed": str(seed), "token": _TOKEN, "rate": rate, "spm": spm_share, **dict(zip("psm", marks, strict=True))}

    def run(batches):
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        con.execute("SET enable_progress_bar = false")
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                con.register("slice", pa.table({"place": pa.array(range(b - a), pa.int64()), "id": ids, "text": batch.column(1).slice(a, b - a)}))
                out = con.sql(_SQL, params=fixed).to_arrow_table()
                con.unregister("slice")
                out = out.select(["n", "form", "prefix_chars", "middle_chars", "output"]).add_column(0, "id", ids).combine_chunks()
                yield from out.to_batches()

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`fill_in_middle` was given: a transformed text holds each mark once."""
    p, s, m = marks
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
