"""Fill-in-middle documents, cut and reordered by DuckDB inside Arrow tasks.

A text is cut into units (a run of ASCII letters, or any other single character). Two cuts drawn from the hash of the
document's key part the units into prefix, middle and suffix, which a document of form psm or spm holds in another order
behind markers; a plain one is left as it is. Every batch is registered with a DuckDB connection of the task and comes back as
Arrow, so no row is touched in Python. A connection sees at most 2 MB of texts at a time, or one text, whatever its length.

A null text counts as empty and a null key as an empty one. A text that is empty or holds a marker is plain, so a marker in an
output stands where one was put and `restore` is exact. Equal keys draw equal numbers; rows are told apart by nothing else, so
repeated rows give repeated results. Columns other than the key and the text are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import groups

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
SEED, CHANGED, SPM = 1, 90, 20  # the hash's salt; per cent of documents that are changed, and of those in the order spm

_MADE = f"""
cut AS MATERIALIZED (
  SELECT key, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS unit, sha256($salt || coalesce(seed, '')) AS hash FROM batch
), drawn AS (
  SELECT key, text, unit, len(unit) AS n, {", ".join(f"CAST('0x' || substr(hash, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM cut
), placed AS (
  SELECT key, text, unit, n, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS last,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= $changed THEN 'plain'
      WHEN h4 % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS MATERIALIZED (
  SELECT key, text, n, form, coalesce(array_to_string(list_slice(unit, 1, first), ''), '') AS prefix,
    coalesce(array_to_string(list_slice(unit, first + 1, last), ''), '') AS middle, coalesce(array_to_string(list_slice(unit, last + 1, n), ''), '') AS suffix
  FROM placed
), made AS MATERIALIZED (
  SELECT key, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
  FROM parts
)"""
#: From form and output alone; a part follows its own marker up to the next one.
_RESTORED = f"""
split AS (
  SELECT *, string_split(output, CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS half FROM made
), thirds AS (
  SELECT *, substr(half[1], 4) AS one, string_split(half[2], '{MIDDLE}') AS rest FROM split
), restored AS (
  SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || rest[2] || rest[1] ELSE rest[1] || rest[2] || one END AS restored FROM thirds
)"""


def _through(sql: str, schema: pa.Schema, numbers: dict, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches by way of DuckDB, as the table `batch` of the SQL, in groups of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                for part in groups(batch, column):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql, params=numbers).to_arrow_table().cast(schema).to_batches()
                    con.unregister("batch")

    return run


def _made(docs: DataFrame, key: str, text: str, sql: str, columns: dict[str, str], seed: int, changed: int, spm: int) -> DataFrame:
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{key}`").cast("string").alias("seed"), F.col(f"`{text}`").cast("string").alias("text"))
    out = ", ".join(f"`{c}` {kind}" for c, kind in {key: docs.select(f"`{key}`").schema[0].dataType.simpleString(), **columns}.items())
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(key, rows.select("key").limit(0).toArrow().schema.field(0).type), *((c, kinds[kind]) for c, kind in columns.items())])
    return rows.mapInArrow(_through(sql, schema, {"salt": f"{seed}:", "changed": changed, "spm": spm}, "text"), out)


_COLUMNS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, changed: int = CHANGED, spm: int = SPM) -> DataFrame:
    """The key, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row."""
    sql = f'WITH {_MADE} SELECT key AS "{key}", {", ".join(_COLUMNS)}, output FROM made'
    return _made(docs, key, text, sql, _COLUMNS | {"output": "string"}, seed, changed, spm)


def restore(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key and the text of every row, rebuilt from its form and output."""
    rows = made.select(F.col(f"`{key}`").alias("key"), "form", "output")
    schema = pa.schema([(key, rows.select("key").limit(0).toArrow().schema.field(0).type), ("text", pa.string())])
    sql = f'WITH made AS (SELECT * FROM batch), {_RESTORED} SELECT key AS "{key}", restored AS text FROM restored'
    return rows.mapInArrow(_through(sql, schema, {}, "output"), f"`{key}` {rows.schema['key'].dataType.simpleString()}, text string")


def digest(docs: DataFrame) -> DataFrame:
    """The same with hashes instead of the texts; an output is taken apart again where it was made."""
    sql = f"WITH {_MADE}, {_RESTORED} SELECT key AS doc_id, {', '.join(_COLUMNS)}, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM restored"
    return _made(docs, "doc_id", "text", sql, _COLUMNS | {"output_sha256": "string", "restored_sha256": "string"}, SEED, CHANGED, SPM)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda u: length(u)) AS size, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT doc_id, text, size, len(size) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(size) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(size) + 1) AS two,
    regexp_matches(text, '<[PSM]>') OR text = '' OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 AS spm FROM d
), y AS (
  SELECT *, CAST(coalesce(list_sum(size[:least(one, two)]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(size[:greatest(one, two)]), 0) AS BIGINT) AS q FROM x
), z AS (
  SELECT *, substring(text, 1, p) AS prefix, substring(text, p + 1, q - p) AS middle, substring(text, q + 1) AS suffix FROM y
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN q - p END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM z
"""


def brute_force(doc_id: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one document, for tests."""
    text = text or ""
    units = re.findall(UNIT, text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"
