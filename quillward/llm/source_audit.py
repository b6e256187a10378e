"""Divergence of the sources of a language, from an inverted index with a corrected baseline.

Of every language the terms that stand in at least ``least`` documents are kept. A source gives each kept
term a whole-number share p, smoothed by two occurrences, and two shares differ by
f = floor((p - q)^2 / (p + q)). Two sources are as far apart as f summed over all kept terms.

Most terms are missing from most sources, so a pair begins with what V terms give that neither source has,
and corrections are added: for every count that a source has, how often it has it, against the other
source's share of a missing term (``single``); and for a term that both sources have, what still lacks then
(``double``), which comes from the term's postings, as long as it is not zero. So work follows the postings,
not sources times terms. All numbers are whole: longs, and decimals of 38 digits where a product may be larger.

Words are counted inside the tasks that read the texts, in tables of a fixed size that are given on when they
are full, and Spark adds them up; no group of a source or a term is gathered in one place. A source of many
documents adds to tables only. Null text, language and source count as empty, repeated rows count each, the
language '' is a language like any other, an empty table gives no rows, and columns beside those named do not
matter. Texts are read whole at any length. A source that is alone in its language has no pairs; a language
without kept terms has pairs of value 0. Ties are ranked by the UTF-8 bytes of the item.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillward.llm import common

#: Smoothing of a count and the whole that shares are parts of.
SMOOTH, WHOLE = 2, 1_000_000_000
#: Entries of a task's table of counts before they are given on, and rows of a batch.
ENTRIES, BATCH = 150_000, 20_000
#: Bytes that words are made of, as lower-case letters; others become blanks.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a source and documents that have it. Every group
    that occurs has a row with the term '' and n = docs = 0 too."""
    common.ready(spark)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def given(tables):
        for (lang, source), (n, docs) in tables.items():
            terms = [b"", *n]
            for i in range(0, len(terms), BATCH):
                part = terms[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], schema=schema)

    def rows(batches):
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            langs, sources = (common.texts_of(batch.column(c)) for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, common.texts_of(batch.column("text")), strict=True):
                table = tables.get((lang, source))
                if table is None:
                    table = tables[lang, source] = Counter(), Counter()
                    held += 1
                own = Counter(text.encode("utf-8", "replace").translate(LETTERS).split())
                held -= len(table[1])
                table[0].update(own)
                table[1].update(own.keys())
                held += len(table[1])
                if held >= ENTRIES:
                    yield from given(tables)
                    tables, held = {}, 0
        yield from given(tables)

    own = docs.select(*(F.col(c).cast("string").alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    part = own.mapInArrow(common.trimmed(rows), "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * terms)); null where nothing is kept."""
    over = (count + SMOOTH).cast("decimal(19,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    under = (total + SMOOTH * terms).cast("decimal(19,0)")
    return F.when(under > 0, F.call_function("div", over, under) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, which are 1 at least and so small enough for longs."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The index of a table of documents; its parts are DataFrames over scratch tables in the shared folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least: int = 10, **columns: str):
        scratch = common.Scratch(spark, "audit")
        found = scratch.keep(counts(spark, docs, **columns), "counts")
        terms = found.where("term != ''").groupBy("lang", "term")
        #: (lang, term, total, postings array<(source, n)>) of the kept terms
        self.index = scratch.keep(terms.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings")).where(F.col("docs") >= least).drop("docs"), "index")
        self.flat = self.index.select("lang", "term", "total", F.inline("postings"))
        langs = self.index.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
        own = self.flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = found.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
        #: (lang, source, total, terms, lang_total, missing): missing is the share of a term that the source lacks
        self.groups = scratch.keep(groups.withColumn("missing", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")

    def top_terms(self, most: int = 10) -> DataFrame:
        """(lang, source, item, value, rank) of the terms that a source has more often than its language."""
        known = self.groups.select("lang", "source", F.col("total").alias("source_total"), "terms", "lang_total")
        p, q = share(F.col("n"), F.col("source_total"), F.col("terms")), share(F.col("total"), F.col("lang_total"), F.col("terms"))
        rows = self.flat.join(known, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank) of every two sources of a language, both ways."""
        mine = self.groups.select("lang", "source", "terms", F.col("missing").alias("p0"), F.col("total").alias("source_total"))
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("missing").alias("q0"))
        both = mine.join(other, "lang").where(F.col("source") != F.col("item"))  # the rows of the result
        base = both.select("lang", "source", "item", F.coalesce(F.col("terms") * apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
        # How often a source has a count: the terms themselves do not matter against a source that lacks them.
        often = self.flat.groupBy("lang", "source", "n").agg(F.count("*").alias("often"))
        counted = often.join(mine, ["lang", "source"]).select("lang", "source", share(F.col("n"), F.col("source_total"), F.col("terms")).alias("p"), "p0", "often")
        single = counted.join(other, "lang").where(F.col("source") != F.col("item"))
        single = single.select("lang", "source", "item", (F.col("often") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("value"))
        single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        back = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        # Terms of both sources, each pair once, the smaller name first.
        shares = self.flat.join(mine, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("source_total"), F.col("terms")).alias("p"), "p0")
        lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings"))
        one = lists.select("lang", "postings", F.explode("postings").alias("a"))
        two = one.select("lang", "a", F.explode(F.filter("postings", lambda b: b["source"] > F.col("a.source"))).alias("b"))
        p, p0, q, q0 = (F.col(x) for x in ("a.p", "a.p0", "b.p", "b.p0"))
        double = two.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value")).where("value != 0")
        double = double.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        again = double.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        total = base.unionByName(single).unionByName(back).unionByName(double).unionByName(again).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        return total.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(spark: SparkSession, docs: DataFrame, least: int = 10, most: int = 10, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for all other sources of the language, part `term` for the
    `most` terms by which a source stands out most."""
    found = Audit(spark, docs, least, **columns)
    parts = [df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for name, df in (("pair", found.pairs()), ("term", found.top_terms(most)))]
    return parts[0].unionByName(parts[1])


def oracle(least: int = 10, most: int = 10) -> str:
    """The same from the texts in DuckDB, pair by pair and term by term."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share_of = lambda n, total: f"(1 + ({WHOLE}::hugeint * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v))"
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""
with words as (select coalesce(lang, '') as lang, coalesce(source, '') as source, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term, row from (select *, row_number() over () as row from documents)),
groups as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
counted as (select lang, source, term, count(*) as n from words group by all),
kept as (select lang, term, count(*) as total from words group by all having count(distinct row) >= {least}),
langs as (select lang, count(*) as v, sum(total) as lang_total from kept group by all),
grid as (select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sized as (select *, sum(n) over (partition by lang, source) as source_total from grid),
shares as (select s.lang, s.source, s.term, s.n, {share_of("n", "source_total")} as p, {share_of("total", "lang_total")} as q from sized s join langs using (lang)),
value_of as (select a.lang, a.source, b.source as item, sum({f.replace("p", "a.p").replace("q", "b.p")}) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source != b.source left join value_of w on w.lang = a.lang and w.source = a.source and w.item = b.source),
term as (select lang, source, 'term' as part, term as item, ({f})::bigint as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pair union all from term))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {most}
"""
