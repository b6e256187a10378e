"""Secret scans in DataFrame expressions only.

Fixed rules give ``assign``, ``access`` and ``hex`` spans. Beside them, every candidate
string (a run of key characters, at least one window long, with a digit and a letter)
belongs to the narrowest character class that holds all its characters: hexadecimal
digits of one case, digits with letters of one case, or all key characters; each class
has its own least entropy. A window slides over the candidate: a table of counts, one
digit per character of the class alphabet, changes in two places by the character that
enters and the one that leaves, and with it the sum of ``k log2 k`` that makes the
Shannon entropy. Time is linear in the candidate's length. Candidates with an
allow-listed piece are suppressed; rule spans never are.

Entropy is compared in whole millionths of ``k log2 k``, so results do not depend on
float order. Null is the empty text. Spans are code points, end exclusive; repeated rows
keep one row each. Texts are read whole; a text without a span has empty lists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rules (fixed values): kind, pattern, group whose length counts, least length.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
#: The same spans with fewer tries: maximal runs of enough digits.
QUICK = {"hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of candidates; the count of each has its place in this order.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Character classes, narrowest first: name, pattern of a whole candidate, least bits of a window.
CLASSES = [("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), ("one case", "^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.6), ("mixed", "", 3.8)]
#: Pieces of well-known harmless strings; lower case.
ALLOW = ["example", "placeholder", "changeme", "xxxxxxxx", "00000000", "12345678", "abcdefgh", "sha256-", "sha384-", "sha512-"]


def weight(k: int) -> int:
    """k log2 k in millionths."""
    return round(1e6 * k * math.log2(k)) if k > 1 else 0


def most_weight(bits: float, window: int) -> int:
    """The largest sum of weights at which a window still has so many bits."""
    return int(window * (math.log2(window) - bits) * 1e6)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, though use names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _added(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)


def _cells(x: Column) -> Column:
    """A non-empty array in slices of 64."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int")), lambda c: F.slice(x, c * 64 + 1, F.lit(64)))


def _starts(gaps: Column, hits: Column) -> Column:
    """Start of each hit: what the gaps and hits before it span, summed in cells and over sums of cells."""
    def within(w):
        return F.transform(w["cell"], lambda n, j: w["before"] + _added(F.slice(w["cell"], F.lit(1), j + 1)))

    def over(z):
        each = lambda cell, c: _let(F.struct(cell.alias("cell"), _added(F.slice(z["sums"], F.lit(1), c)).alias("before")), within)
        return F.flatten(F.transform(z["cells"], each))

    spans = _let(F.struct(gaps.alias("g"), hits.alias("h")), lambda z: F.zip_with(F.slice(z["g"], F.lit(1), F.size(z["h"])), z["h"], lambda g, h: (F.length(g) + F.length(h)).cast("long")))
    ends = _let(spans, lambda x: _let(_cells(x), lambda cells: _let(F.struct(cells.alias("cells"), F.transform(cells, _added).alias("sums")), over)))
    return F.zip_with(ends, hits, lambda e, h: e - F.length(h))


def _found(df: DataFrame, kind: int, pattern: str, group: int, least: int) -> DataFrame:
    """Adds _span<kind>: array of (start, kind, end, hit, size) for matches of the pattern; size: of the group that counts."""
    df = df.withColumn("_hits", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    some = F.size("_hits") > 0
    kept = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else F.col("_hits")
    at = F.arrays_zip(F.col("_hits").alias("hit"), kept.alias("own"), _starts(F.split("_text", pattern, -1), F.col("_hits")).alias("at"))
    spans = F.transform(at, lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), F.length(x["own"]).alias("size")))
    return df.withColumn(f"_span{kind}", F.when(some, F.filter(spans, lambda x: x["size"] >= least)).otherwise(F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint,hit:string,size:int>>"))).drop("_hits")


def least_sum(text: Column, window: int) -> Column:
    """The smallest sum of weights over all windows of a string: one fold over what leaves and what enters.

    The state has a count for each character of ALPHABET, as one character of a string.
    """
    grow = F.array(*[F.lit(weight(k + 1) - weight(k)) for k in range(window + 1)])
    shrink = F.array(*[F.lit(weight(k - 1) - weight(k) if k else 0) for k in range(window + 1)])
    zero = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("best"))
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    event = lambda at, full, enters: F.struct(at.alias("at"), full.alias("full"), F.lit(enters).alias("enters"))

    def events(chars):
        """Of each character: what leaves (from the second window on), then what enters."""
        return F.flatten(F.transform(chars, lambda c, i: F.when(i >= window, F.array(event(place(F.get(chars, i - window)), F.lit(False), False), event(place(c), F.lit(True), True))).otherwise(F.array(event(place(c), i == window - 1, True)))))

    def step(s, e):
        count = F.ascii(F.substr(s["counts"], e["at"], F.lit(1))) - 48
        total = s["sum"] + F.when(e["enters"], F.get(grow, count)).otherwise(F.get(shrink, count))
        counts = F.overlay(s["counts"], F.char(count + F.when(e["enters"], 49).otherwise(47)), e["at"], F.lit(1))
        return _let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(e["full"], F.least(s["best"], t)).otherwise(s["best"]).alias("best")))

    return F.aggregate(_let(F.split(text, ""), events), zero, step, lambda s: s["best"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, hits.

    hits is an array of (start, kind, end, hit) in the order of spans.
    """
    df = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    for k, (kind, pattern, group, least) in enumerate(RULES):
        df = _found(df, k, QUICK.get(kind, pattern), group, least)
    df = _found(df, 3, CANDIDATE, 0, WINDOW)
    low = lambda x: F.lower(x["hit"])
    likely = lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]") & ~low(x).rlike("|".join(ALLOW))
    df = df.withColumn("_span3", F.filter("_span3", likely))
    most = lambda x: F.coalesce(*[F.when(x["hit"].rlike(own), F.lit(most_weight(bits, WINDOW))) for _, own, bits in CLASSES])
    df = df.withColumn("_span3", F.filter("_span3", lambda x: least_sum(x["hit"], WINDOW) <= most(x)))
    order = lambda x: F.array_sort(x)
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    df = df.withColumn("_base", order(F.concat("_span0", "_span1", "_span2"))).withColumn("_all", order(F.concat("_span0", "_span1", "_span2", "_span3")))
    joined = lambda c: F.array_join(F.transform(c, name), ",")
    return df.select(
        id_col,
        *[F.size(f"_span{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_all").alias("spans"),
        F.size("_span3").cast("long").alias("n_entropy"),
        F.transform("_all", lambda x: F.struct(x["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"))).alias("hits"),
    )


def oracle() -> str:
    """DuckDB SQL for doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of documents."""
    def found(k: int, kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""
 h{k} as (select rid, t, regexp_extract_all(t, '{p}', 0) h, regexp_extract_all(t, '{p}', {group}) g, string_split_regex(t, '{p}') s from d),
 s{k} as (select rid, {k} k, unnest(range(1, len(h) + 1)) i, h, g, s from h{k} where len(h) > 0),
 k{k} as (select rid, k, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) a, length(h[i]) n, h[i] hit from s{k} where length(g[i]) >= {least})"""

    rules = ",".join(found(k, *r) for k, r in enumerate([*RULES, ("entropy", CANDIDATE, 0, WINDOW)]))
    allow = "|".join(ALLOW)
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),{rules},
 c3 as (select row_number() over () cid, * from k3 where regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]') and not regexp_matches(lower(hit), '{allow}')),
 w3 as (select cid, unnest(range(1, length(hit) - {WINDOW - 2})) i, hit from c3),
 n3 as (select cid, i, ch, count(*) n from (select cid, i, unnest(string_split(substr(hit, i, {WINDOW}), '')) ch from w3) group by all),
 e3 as (select cid, min(e) best from (select cid, i, sum(case when n > 1 then round(1e6 * n * log2(n)) else 0 end) e from n3 group by all) group by all),
 f3 as (select rid, k, a, n, hit from c3 join e3 using (cid) where best <= case {' '.join(f"when regexp_matches(hit, '{own}') then {most_weight(bits, WINDOW)}" for _, own, bits in CLASSES)} end),
 u as (select * from k0 union all select * from k1 union all select * from k2 union all select * from f3),
 g as (select rid, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex, count(*) filter (k = 3) n_entropy,
  string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || (a + n), ',' order by a, k) filter (k < 3) base,
  string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || (a + n), ',' order by a, k) every from u group by rid)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(every, '') spans, coalesce(n_entropy, 0) n_entropy
from d left join g using (rid)"""


def _marked(text: Column, hits: Column, mark: str) -> Column:
    """The text with each run of overlapping hits (in order of start) as one mark, put together in cells of 64 hits."""
    zero = F.lit(0).cast("long")
    end_of = lambda cell: F.array_max(F.transform(cell, lambda h: h["end"]))

    def piece(w):
        own = F.substr(w["text"], (w["from"] + 1).cast("int"), (F.greatest(end_of(w["cell"]), w["from"]) - w["from"]).cast("int"))

        def fold(z):
            def step(s, h):
                add = F.concat(s["out"], F.substr(z["own"], (s["at"] - z["from"] + 1).cast("int"), (h["start"] - s["at"]).cast("int")), F.lit(mark))
                return F.struct(F.greatest(s["at"], h["end"]).alias("at"), F.when(h["start"] >= s["at"], add).otherwise(s["out"]).alias("out"))

            return F.aggregate(z["cell"], F.struct(z["from"].alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

        return _let(F.struct(own.alias("own"), w["from"].alias("from"), w["cell"].alias("cell")), fold)

    def over(z):
        each = lambda cell, c: _let(F.struct(z["text"].alias("text"), cell.alias("cell"), F.coalesce(F.array_max(F.slice(z["ends"], F.lit(1), c)), zero).alias("from")), piece)
        return F.concat(F.array_join(F.transform(z["cells"], each), ""), F.substr(z["text"], (F.array_max(z["ends"]) + 1).cast("int")))

    return _let(_cells(hits), lambda cells: _let(F.struct(text.alias("text"), cells.alias("cells"), F.transform(cells, end_of).alias("ends")), over))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with every span of secret_scan replaced by mark; overlapping spans
    become one mark. size_col, where it exists, follows a changed text. Null texts stay null."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    found = secret_scan(packed, "_row", "_t").select("_row", F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("_hits"))
    text = F.col("_row")[text_col]
    found = found.withColumn("_new", F.when(F.size("_hits") > 0, _marked(text, F.col("_hits"), mark)).otherwise(text))
    kind = dict(docs.dtypes)
    columns = []
    for c in names:
        if c == text_col:
            columns.append(F.col("_new").alias(c))
        elif c == size_col:
            columns.append(F.when(F.size("_hits") > 0, F.length("_new").cast(kind[c])).otherwise(F.col("_row")[c]).alias(c))
        else:
            columns.append(F.col("_row")[c].alias(c))
    return found.select(*columns)
