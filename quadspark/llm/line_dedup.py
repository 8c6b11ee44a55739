"""Line dedup: Bloom filters of once-seen and twice-seen line hashes; only suspected repeats shuffle.

A line whose key's hash is not in the merged `twice` filter (see bloom) stands once; the others are suspects, written to the
shared folder, confirmed by their whole keys and dropped in all documents but the first. The filters grow with the number of
lines up to 2^30 bits (128 MB each): there, lines seen once are suspects with probability 0.005 at 67 million lines, 0.03 at
134 million, 0.18 at 360 million and 0.83 at a billion. A corpus that fills the filter sends more lines to that exact step and loses nothing.

Nulls and ties: a null or empty text is one empty line. Rows of equal doc_id count as one document. A null doc_id counts as
the largest id, so its lines go when any other document has them. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Filter
from .common import SPACES, ascii_lower, stored, table

MIN_CHARS = 10
#: A line seen once is a suspect with probability 0.005 at 16 bits a line, and less where lines repeat.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
_LAST = (1 << 63) - 1


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(SPACES)))
    return (
        docs.select("_id", "_row", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .select("_id", "_row", "_pos", key.alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .withColumn("_hash", F.xxhash64("_key"))
    )


def filter_size(docs: DataFrame) -> int:
    """Bits for the lines of docs (_text): BITS_PER_LINE each, a power of two, not over MOST_BITS."""
    n = docs.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * n).bit_length()))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each text without the lines whose key stands in a document of smaller id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumns({"_id": F.coalesce("doc_id", F.lit(_LAST)), "_row": F.xxhash64("_text")})
    lines = _lines(docs, min_chars)
    twice = Filter(lines.select("_hash"), "twice", filter_bits or filter_size(docs))
    suspects = stored(lines.filter(twice.passes("_hash")), "suspects")
    repeats = suspects.groupBy("_hash", "_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last")
    # written, so that the join has two plain sides and a line that very many documents have is dealt over several tasks
    repeats = stored(repeats.drop("_last"), "repeats")
    drops = suspects.join(repeats, ["_hash", "_key"]).filter("_id > _first").groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))
    lines_of = F.split("_text", "\n")
    kept = docs.join(drops, ["_id", "_row"], "left").withColumn("_lines", lines_of)
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("_lines", i)), "\n"))
    return kept.select("doc_id", text.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), repeated as (
  select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1
), marked as (
  select keyed.*, coalesce(doc_id > first, false) as gone from keyed left join repeated using (k)
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
