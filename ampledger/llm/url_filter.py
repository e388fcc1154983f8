"""URL filter: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, share an
alphabet of 35 symbols and contexts of up to five: the longest context seen often enough is
used, mixed with the shorter ones. Counts, probabilities and the log ratio of each gram are
DataFrames whose rows grow with the corpus; a URL's score is the mean ratio of its symbols,
by a join. The cut is calibrated on the URLs that rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.llm.common import cut, table

#: (verdict, host, path), as given; a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
A = 35  # symbols: a-z, 0 for any digit, - . / _ % ~, * for any other, ^ for the start
CONTEXT = 5  # symbols of the longest context
SMOOTH = 4.0  # weight of the shorter context, in symbols
SUPPORT = 20  # occurrences, in both models together, from which a context is used
BROADCAST_GRAMS = 1_000_000  # rows of the table of ratios that may be broadcast: at some 80 bytes each, 80 MB
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule text; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def grams_of(host: Column, path: Column, context: int = CONTEXT) -> Column:
    """One string per symbol of host and path: the ``context`` symbols before it, then the symbol.

    One pass of a look-ahead pattern over the text, so the work grows with its length.
    """
    text = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "0" * 9)
    text = F.concat(F.lit("^" * context), F.regexp_replace(text, r"[^a-z0\-./_%~]", "*"))
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{context + 1}}}))"), F.lit(1))


def ratio_table(labelled: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``gram, llr`` of every gram in ``labelled(verdict, gram)``; rows of other verdicts count for nothing.

    Orders are built from the shortest up, each from the counts of the next longer one, so that
    every table is an aggregate of distinct grams. Add-half unigrams; a context that occurs
    SUPPORT times or more mixes its counts with SMOOTH symbols' worth of the next shorter one,
    any other takes the shorter one's figure. So the contexts in use grow with the corpus.
    """
    is_of = {"0": F.col("verdict") == "block", "1": F.col("verdict") == "allow"}
    sums = [F.sum(F.coalesce(y.cast("long"), F.lit(0))).alias(f"n{m}") for m, y in is_of.items()]
    orders = [cut(labelled.groupBy("gram").agg(*sums), "url-grams")]
    for _ in range(context):
        shorter = F.substring("gram", 2, context + 1).alias("gram")
        orders.insert(0, orders[0].groupBy(shorter).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    whole = orders[0].agg(*(F.coalesce(F.sum(f"n{m}"), F.lit(0)) for m in "01")).first()
    model = orders[0].select("gram", *((F.col(f"n{m}") + 0.5) / (whole[int(m)] + 0.5 * A) for m in "01")).toDF("gram", "p0", "p1")
    for k in range(1, context + 1):
        seen = orders[k].withColumns({"context": F.substring("gram", 1, k), "shorter": F.substring("gram", 2, k)})
        held = seen.groupBy("context").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        below = model.select(F.col("gram").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        both = seen.join(held, "context").join(below, "shorter")
        used = F.col("c0") + F.col("c1") >= SUPPORT
        mixed = {m: (F.col(f"n{m}") + SMOOTH * F.col(f"q{m}")) / (F.col(f"c{m}") + SMOOTH) for m in "01"}
        model = both.select("gram", *(F.when(used, mixed[m]).otherwise(F.col(f"q{m}")).alias(f"p{m}") for m in "01"))
    return model.select("gram", F.floor(1000 * (F.log("p1") - F.log("p0")) + 0.5).cast("int").alias("llr"))


def calibrate(scored: DataFrame) -> int:
    """The cut on ``score`` with the best balanced accuracy over ``scored(verdict, score)``; 0 without both verdicts.

    Cuts lie half-way between neighbouring scores. Ties go to the cut nearest zero, then to the greater. Scores are whole numbers held to
    +-5000, so at most 10,001 rows are sorted and one reaches the driver.
    """
    score = F.greatest(F.lit(-5000), F.least(F.lit(5000), F.col("score"))).alias("score")
    tally = scored.groupBy(score).agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("good"),
        F.sum((F.col("verdict") == "block").cast("long")).alias("bad"),
    )
    below, everything = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = (F.sum("good").over(everything) - F.coalesce(F.sum("good").over(below), F.lit(0))) / F.sum("good").over(
        everything
    ) + F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(everything)
    both = (F.sum("good").over(everything) > 0) & (F.sum("bad").over(everything) > 0)
    before = F.coalesce(F.lag("score").over(Window.orderBy("score")), F.col("score"))
    cut_at = F.floor((F.col("score") + before + 1) / 2).cast("int").alias("cut")
    ranked = tally.select(cut_at, F.when(both, F.round(share, 9)).alias("share")).where("share is not null")
    best = ranked.orderBy(F.desc("share"), F.abs("cut"), F.desc("cut")).first()
    return best["cut"] if best else 0


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, cut`` for every row of ``pages``.

    ``score``: the mean log ratio of a symbol in thousandths of a nat, a whole number. A url
    that is null or has no ``://`` has empty host and path, fits no rule and scores 0. Where no
    rule fits, the verdict is allow if the score reaches the calibrated cut. All pages that
    rules decide train and calibrate the models; if one kind is missing the cut is 0. Repeated
    rows give repeated results, other columns are not read, very long urls are scored whole in
    linear time, an empty table gives an empty result.

    Grams meet the table of log ratios in a broadcast join only if its rows are counted to be
    few; beyond that both sides are dealt over salts, as some grams are in nearly every url.
    """
    url = F.col(url_col)
    # A generator stands between the text functions and their uses, so that each runs once a row.
    split = F.inline(F.array(F.struct(host_of(url).alias("host"), path_of(url).alias("path"))))
    parts = pages.select(F.col(id_col).alias("page_id"), split).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    parts = cut(parts.withColumn("row_id", F.monotonically_increasing_id()), "url-parts")
    gram = F.explode(grams_of(F.col("host"), F.col("path"))).alias("gram")
    ratios = cut(ratio_table(parts.select(F.col("by.verdict").alias("verdict"), gram)), "url-ratios")
    spots = parts.select("row_id", gram)
    if ratios.count() <= BROADCAST_GRAMS:
        met = spots.join(F.broadcast(ratios), "gram")
    else:
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = spots.withColumn("salt", F.pmod(F.hash("row_id"), F.lit(SALTS)))
        met = dealt.join(salted.hint("shuffle_hash"), ["gram", "salt"])
    means = met.groupBy("row_id").agg(F.floor(F.sum("llr") / F.count("*")).cast("int").alias("score"))
    scored = parts.join(means, "row_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    scored = cut(scored.drop("row_id"), "url-scores")
    cut_at = calibrate(scored.where("by is not null").select("by.verdict", "score"))
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(F.col("score") >= cut_at, "allow").otherwise("block")).alias("verdict"),
        "score",
        F.lit(cut_at).alias("cut"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_levels() -> str:
    """CTEs ``t0`` to ``t{CONTEXT}`` of counts and ``m0`` to ``m{CONTEXT}`` of probabilities."""
    out = [f"t{CONTEXT} AS (SELECT gram, count(*) FILTER (said = 'block') AS n0, count(*) FILTER (said = 'allow') AS n1 FROM spots GROUP BY gram)"]
    for k in range(CONTEXT - 1, -1, -1):
        out.append(f"t{k} AS (SELECT substr(gram, 2) AS gram, CAST(sum(n0) AS BIGINT) AS n0, CAST(sum(n1) AS BIGINT) AS n1 FROM t{k + 1} GROUP BY 1)")
    half = lambda m: f"(n{m} + 0.5::DOUBLE) / ((SELECT sum(n{m}) FROM t0) + {0.5 * A}::DOUBLE) AS p{m}"
    out.append(f"m0 AS (SELECT gram, {half(0)}, {half(1)} FROM t0)")
    for k in range(1, CONTEXT + 1):
        mix = lambda m: f"CASE WHEN c0 + c1 >= {SUPPORT} THEN (n{m} + {SMOOTH}::DOUBLE * b.p{m}) / (c{m} + {SMOOTH}::DOUBLE) ELSE b.p{m} END AS p{m}"
        out.append(f"c{k} AS (SELECT left(gram, {k}) AS context, CAST(sum(n0) AS BIGINT) AS c0, CAST(sum(n1) AS BIGINT) AS c1 FROM t{k} GROUP BY 1)")
        out.append(f"m{k} AS (SELECT t.gram, {mix(0)}, {mix(1)} FROM t{k} t JOIN c{k} ON context = left(t.gram, {k}) JOIN m{k - 1} b ON b.gram = substr(t.gram, 2))")
    return ",\n".join(out)


OP6_SQL = f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN coalesce(instr(url, '://'), 0) > 0
      THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
    CASE WHEN coalesce(instr(url, '://'), 0) > 0
      THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    '{"^" * CONTEXT}' || regexp_replace(translate(host || path, '{_UPPER}123456789', '{_LOWER}000000000'), '[^a-z0\\-./_%~]', '*', 'g') AS s,
    row_number() OVER () AS row_id
  FROM parts),
judged AS (
  SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM ruled),
places AS (SELECT row_id, said, s, unnest(range(1, length(s) - {CONTEXT - 1})) AS i FROM judged),
spots AS (SELECT row_id, said, substr(s, i, {CONTEXT + 1}) AS gram FROM places),
{_sql_levels()},
ratios AS (SELECT gram, CAST(floor(1000 * (ln(p1) - ln(p0)) + 0.5) AS BIGINT) AS llr FROM m{CONTEXT}),
scores AS (
  SELECT row_id, CAST(floor(CAST(sum(llr) AS DOUBLE) / count(*)) AS BIGINT) AS score
  FROM spots JOIN ratios USING (gram) GROUP BY row_id),
scored AS (SELECT j.*, coalesce(score, 0) AS score FROM judged j LEFT JOIN scores USING (row_id)),
tally AS (
  SELECT greatest(-5000, least(5000, score)) AS score, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad
  FROM scored WHERE said IS NOT NULL GROUP BY 1),
shares AS (
  SELECT CAST(floor((score + coalesce(lag(score) OVER (ORDER BY score), score) + 1) / 2.0) AS BIGINT) AS cut, round(CAST(sum(good) OVER () - coalesce(sum(good) OVER below, 0) AS DOUBLE) / nullif(sum(good) OVER (), 0)
      + CAST(coalesce(sum(bad) OVER below, 0) AS DOUBLE) / nullif(sum(bad) OVER (), 0), 9) AS share
  FROM tally WINDOW below AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce(first(cut ORDER BY share DESC, abs(cut), cut DESC), 0) AS cut FROM shares WHERE share IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= (SELECT cut FROM best) THEN 'allow' ELSE 'block' END) AS verdict
FROM scored
"""
