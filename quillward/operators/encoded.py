"""Numeric references and image hosts without Python: decoded in place, joined to tiers by their longest suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillward.functions import rules
from quillward.functions.rules import pattern
from quillward.operators import detectors as D
from quillward.operators.places import events_of, placed, stream

REF = "&#(?:x([0-9a-fA-F]+)|([0-9]+));"
#: Characters of a decoded text that are searched for phrases, as the rules say.
SEARCHED = 4096
HOST = r"(?i)^https?:[/\\]*(?:[^/?#@\\]*@)?([^/?#:\\]+)"
DOTTED = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
PRIVATE = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."


def character(ref: Column) -> Column:
    """What a numeric reference stands for; beyond the last character it stays as it is, and a half of a pair becomes a
    replacement character."""
    hexa, plain = (F.ltrim(F.regexp_extract(ref, REF, k), F.lit("0")) for k in (1, 2))
    code = F.when(F.length(F.regexp_extract(ref, REF, 1)) > 0, F.when(F.length(hexa) < 9, F.conv(F.concat(F.lit("0"), hexa), 16, 10).cast("long"))).otherwise(F.when(F.length(plain) < 9, F.concat(F.lit("0"), plain).cast("long")))
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.isNull() | (code > 0x10FFFF), ref).when(code.between(0xD800, 0xDFFF), "�").otherwise(letter)


def decoded(text: Column) -> Column:
    """The text with its numeric references decoded in place."""
    refs = F.regexp_extract_all(text, F.lit(REF), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, REF, -1), refs, lambda a, r: F.concat(a, F.when(r.isNull(), "").otherwise(character(r)))), "")


def entity_payloads(docs: DataFrame, searched: int | None = SEARCHED) -> DataFrame:
    """(doc_id, position, match_len, n_islands, n_refs) of docs(doc_id, text) whose references spell a phrase: the range of the
    longest run of references without a gap, the first of equals, in UTF-16 units. searched None looks at all of the
    decoded text."""
    plain = decoded(F.col("text"))
    plain = plain if searched is None else F.substring(plain, 1, searched)
    phrase = "(?i)" + "|".join(f"(?:{pattern(p, '')})" for p in rules.DECODED_PHRASES)
    own = docs.where(F.col("text").contains("&#")).where(plain.rlike(phrase))
    refs = placed(events_of(own, stream(F.col("text"), REF, "ref")))
    order = Window.partitionBy("rid").orderBy("k")
    end = F.col("start") + F.col("size")
    apart = F.when(F.lag(end).over(order) == F.col("start"), 0).otherwise(1)
    runs = refs.withColumn("_new", apart).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("rid", "doc_id", "_run").agg(F.min("start").alias("low"), F.max(end).alias("high"), F.count("*").alias("n"))
    best = F.max_by(F.struct("low", "high"), F.struct(F.col("high") - F.col("low"), -F.col("low")))
    out = runs.groupBy("rid", "doc_id").agg(best.alias("r"), F.count("*").alias("n_islands"), F.sum("n").alias("n_refs"))
    return out.select("doc_id", F.col("r.low").cast("int").alias("position"), (F.col("r.high") - F.col("r.low")).cast("int").alias("match_len"), "n_islands", "n_refs")


def tiers(spark: SparkSession) -> DataFrame:
    """(suffix, below, tier, rank): fixed hosts; below tells whether what lies under a host counts too."""
    rows = [(h, True, "image-only", 2) for h in rules.IMAGE_HOSTS] + [(h, False, "image-only", 2) for h in rules.CONTENT_HOSTS] + [(h, True, "trusted-allowlist", 1) for h in rules.TRUSTED_HOSTS]
    return spark.createDataFrame(rows, "suffix string, below boolean, tier string, rank int")


def image_hosts(docs: DataFrame) -> DataFrame:
    """(doc_id, url, host, tier, matched) of the inline images of docs(doc_id, text): the tier of the longest listed suffix of
    a host, image hosts before trusted ones, then written-out addresses, else unknown. A list of about a hundred hosts
    is sent to all tasks; images are not shuffled but to be put together again."""
    urls = docs.where(F.col("text").contains("![")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.explode(D.image_links("text")).alias("u"))
    urls = urls.select(F.concat_ws("-", "rid", F.monotonically_increasing_id()).alias("one"), "doc_id", F.col("u.url").alias("url"), F.lower(F.regexp_extract("u.url", HOST, 1)).alias("host")).where("host != ''")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    each = urls.withColumn("suffix", F.explode(suffixes)).join(F.broadcast(tiers(docs.sparkSession)), "suffix", "left")
    listed = F.when(F.col("below").isNotNull() & (F.col("below") | (F.col("suffix") == F.col("host"))), F.struct("rank", F.length("suffix").alias("size"), "tier", "suffix"))
    out = each.groupBy("one", "doc_id", "url", "host").agg(F.max(listed).alias("t"))
    literal = F.when(~F.col("host").rlike(DOTTED), "unknown").when(F.col("host").rlike(PRIVATE), "ip-literal-private").otherwise("ip-literal-public")
    return out.select("doc_id", "url", "host", F.when(F.col("t.rank") == 2, F.col("t.tier")).when(F.col("host").rlike(DOTTED), literal).otherwise(F.coalesce("t.tier", literal)).alias("tier"), F.col("t.suffix").alias("matched"))
