"""URL filters by a character language-model ratio (operator 6), in DataFrame operations only.

Rules decide first: a rule ``host/path`` fits its host and all subdomains if the URL's path starts with
the rule's; the longest fitting rule wins (two fitting rules of one length are the same rule, or the one
that sorts first). All other URLs are judged by two variable-order Markov models of characters, one of
accepted and one of rejected URLs: orders 0 to ORDER, smoothed by Witten-Bell interpolation with the next
lower order. A URL is blocked where the log-likelihood difference per character exceeds a threshold.

Seeds: rejected are the URLs that a rule blocks, and those under no rule whose host has one of
REJECT_WORDS as a part; allowed are those that a rule allows; open are all others. The accepted model
learns the allowed URLs, the rejected model the rejected ones; both learn the open ones too, with the weight of
SHARED URLs in all, so that text that only one kind of seed can show, such as ``.com/``, counts little. The models read all that follows ``://``: host, path, query and
fragment. Of a seed under a rule, the text that the rule itself matched isn't learned. Every distinct URL
teaches once, however often it occurs.

Calibration: a quarter of the distinct URLs, by a hash, teaches nothing. The threshold is the smallest
value, 0 at least, that at most FALSE_BLOCKS of the held-out allowed and at most OPEN_BLOCKS of the held-out
open ones exceed. Scores are whole numbers of 1/SCALE, so their histogram has a bounded number of rows.

The alphabet has 41 symbols, so the tables of orders 0 to 2 have at most 43, 43**2 and 43**3 rows and may be
broadcast; higher orders meet by shuffle.

A null URL or one without ``://`` has an empty host and path, no rule, and the method's verdict on an empty
text, which is in no seed. Without rejected or without allowed URLs that teach, or with none held out, every URL outside
the rules is allowed. Very long URLs are judged whole. Repeated rows and keys are judged alike, row by row; an empty table
gives no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm import common

#: Fixed values: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Parts of host names that are common on blocklists.
REJECT_WORDS = ["adult", "ads", "bet", "bets", "casino", "gambling", "loans", "pills", "porn", "sex", "spam", "tracker", "track", "viagra", "xxx"]
ORDER = 4
#: Most of the held-out allowed and of the held-out open URLs that may be blocked, in thousandths.
FALSE_BLOCKS, OPEN_BLOCKS = 5, 10
#: First digits of a URL's MD5 that hold it out for calibration.
HELD = "0123"
#: The open URLs teach each model as much as this many URLs.
SHARED = 10
#: Steps of a score.
SCALE = 10_000
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-/_"  # any other character becomes *


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_of(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((F.col(host) == own) | F.col(host).endswith(f".{own}")) & F.col(path).startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    null = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (null, null)


def model_text(url: str = "url") -> Column:
    """What the models read of a URL: all that follows ``://``, A-Z lower-cased."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    low = F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(low, f"[^{ALPHABET.replace('-', '')}-]", "*")


def _grams(texts: DataFrame) -> DataFrame:
    """texts (t, ...) exploded to its characters with their contexts: i is the place, g has ORDER characters and the next one."""
    padded = F.concat(F.lit("^" * ORDER), F.col("t"), F.lit("$"))
    return texts.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("t") + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("i", "g"))


def gram_scores(grams: DataFrame, share: float = 0.0) -> DataFrame:
    """(g, a, r, o: counts among allowed, rejected and open URLs) -> (g, llr) of the last character.

    llr is log p_rejected - log p_accepted in units of 1e-9; each open URL counts with `share` for both models.
    Sums are of whole numbers, so their order doesn't matter.
    """
    below = None
    for k in range(ORDER + 1):
        own = grams if k == ORDER else grams.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias("g")).agg(*[F.sum(c).alias(c) for c in "aro"])
        w = Window.partitionBy(F.substring("g", 1, k)) if k else Window.partitionBy(F.lit(0))  # at most 43 rows
        over = lambda c: F.sum(c).over(w)
        kinds = lambda c: over(c.cast("long"))
        t = own.select("g", "a", "r", "o", *[over(F.col(c)).alias(f"n{c}") for c in "aro"], *[kinds(F.col(c) + F.col("o") * share > 0).alias(f"t{c}") for c in "ar"])
        if below is None:
            t = t.withColumns({"qa": F.lit(1 / 64), "qr": F.lit(1 / 64)})
        else:
            t = t.withColumn("s", F.substring("g", 2, k)).join(F.broadcast(below) if k <= 3 else below, "s")
        mixed = lambda n, total, kinds, q: F.when(total > 0, (n + F.col(kinds) * F.col(q)) / (total + F.col(kinds))).otherwise(F.col(q))
        counts = lambda c: [F.col(f"{p}{c}") + F.col(f"{p}o") * share for p in ("", "n")]
        t = t.select("g", *[mixed(*counts(c), f"t{c}", f"q{c}").alias(f"p{c}") for c in "ar"])
        below = t.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
    return t.select("g", F.round((F.ln("pr") - F.ln("pa")) * 1e9).cast("long").alias("llr"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, reject_words=REJECT_WORDS) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict and llr (per character; null under a rule)."""
    rows = parse(pages.select(key, F.col(url).cast("string").alias("__url")), "__url")
    rule, says = rule_of(rules)
    listed = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*[F.lit(w) for w in reject_words])) if reject_words else F.lit(False)
    rows = rows.select(key, "host", "path", rule.alias("rule"), says.alias("says"), model_text("__url").alias("t"), listed.alias("listed"))
    # The rule's own text stands once in the URL, from the end of the host on.
    rows = rows.withColumn("at", F.length("host") - F.length(F.substring_index("rule", "/", 1)))
    seed = F.when(F.col("says") == "allow", "a").when((F.col("says") == "block") | F.col("listed"), "r").otherwise("o")
    rows = common.stash(rows.withColumn("seed", seed), "urls")
    held = F.substring(F.md5("t"), 1, 1).isin(*HELD)
    seeds = common.stash(rows.where("t <> ''").select("t", "rule", "at", "seed").distinct().withColumn("held", held), "url-seeds")
    # What a rule itself matched teaches neither model.
    fixed = F.coalesce((F.col("i") >= F.col("at")) & (F.col("i") < F.col("at") + F.length("rule")), F.lit(False))
    taught = lambda s: F.sum((~F.col("held") & ~fixed & (F.col("seed") == s)).cast("long")).alias(s)
    grams = _grams(seeds).groupBy("g").agg(*[taught(s) for s in "aro"])
    n = {r.seed: r for r in seeds.groupBy("seed").agg(F.count(F.when(~F.col("held"), F.lit(1))).alias("n"), F.count(F.when(F.col("held"), F.lit(1))).alias("h")).collect()}
    teach, held_out = lambda s: n[s].n if s in n else 0, lambda s: n[s].h if s in n else 0
    share = SHARED / max(SHARED, teach("o"))
    scored = common.stash(gram_scores(grams, share), "url-grams")
    each = common.join_unique(_grams(seeds.select("t").distinct()), scored, "g", "inner")
    by_text = common.stash(each.groupBy("t").agg(F.floor(F.sum("llr") / (F.count(F.lit(1)) * (1e9 / SCALE))).cast("long").alias("q")), "url-scores")
    able = bool(teach("r")) and bool(teach("a")) and bool(held_out("a") + held_out("o"))
    threshold = _threshold(seeds.where("held AND seed IN ('a', 'o')").select("t", "seed").distinct().join(by_text, "t")) if able else 0
    out = common.join_unique(rows, by_text, "t")
    own = F.when(F.lit(able) & (F.col("q") > threshold), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", "rule", F.coalesce("says", own).alias("verdict"), F.when(F.col("rule").isNull(), F.col("q") / SCALE).alias("llr"))


def _threshold(held: DataFrame) -> int:
    """The smallest score, 0 at least, that at most the wanted shares of held-out allowed and open URLs exceed.

    A score has about 40 * SCALE values at most, so the histogram and its windows are bounded.
    """
    bins = held.groupBy("seed", "q").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("seed")
    above = F.sum("n").over(whole.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("seed", "q", F.coalesce(above, F.lit(0)).alias("above"), F.sum("n").over(whole).alias("all"))
    most = F.when(F.col("seed") == "a", FALSE_BLOCKS).otherwise(OPEN_BLOCKS)
    found = bins.where(F.col("above") * 1000 <= most * F.col("all")).groupBy("seed").agg(F.min("q").alias("q")).collect()
    return max([0, *(r.q for r in found)])


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the verdict on every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql() -> str:
    """DuckDB SQL for the rows of op6."""
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", r, says) for r, says in rules for h, _, p in [r.partition("/")]]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    orders, below = [], "SELECT '' AS s, 1 / 64::DOUBLE AS qa, 1 / 64::DOUBLE AS qr"
    for k in range(ORDER + 1):
        orders.append(f"""n{k} AS (SELECT g, a, r, o, sum(a) OVER w AS na, sum(r) OVER w AS nr, sum(o) OVER w AS no, sum((a + o * share > 0)::INT) OVER w AS ta, sum((r + o * share > 0)::INT) OVER w AS tr
  FROM (SELECT substr(g, {ORDER + 1 - k}, {k + 1}) AS g, sum(a) AS a, sum(r) AS r, sum(o) AS o FROM grams GROUP BY 1), share WINDOW w AS (PARTITION BY substr(g, 1, {k}))),
p{k} AS (SELECT g, CASE WHEN na::DOUBLE + no::DOUBLE * share > 0 THEN (a::DOUBLE + o::DOUBLE * share + ta::DOUBLE * qa) / (na::DOUBLE + no::DOUBLE * share + ta::DOUBLE) ELSE qa END AS pa,
  CASE WHEN nr::DOUBLE + no::DOUBLE * share > 0 THEN (r::DOUBLE + o::DOUBLE * share + tr::DOUBLE * qr) / (nr::DOUBLE + no::DOUBLE * share + tr::DOUBLE) ELSE qr END AS pr
  FROM n{k}, share, ({below}) q WHERE q.s = substr(n{k}.g, 2, {k}))""")
        below = f"SELECT g AS s, pa AS qa, pr AS qr FROM p{k}"
    grams = f"substr('{'^' * ORDER}' || t || '$', i + 1, {ORDER + 1})"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {low}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rows_ AS MATERIALIZED (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS says, regexp_replace(translate(rest, {low}), '[^{ALPHABET.replace("-", "")}-]', '*', 'g') AS t,
  length(host) - length(split_part(rule, '/', 1)) AS at_,
  CASE WHEN says = 'allow' THEN 'a' WHEN says = 'block' OR list_has_any(regexp_split_to_array(host, '[.-]'), {REJECT_WORDS}) THEN 'r' ELSE 'o' END AS seed FROM b),
seeds AS MATERIALIZED (SELECT DISTINCT t, rule, at_, seed, substr(md5(t), 1, 1) IN ({', '.join(f"'{c}'" for c in HELD)}) AS held FROM rows_ WHERE t <> ''),
share AS (SELECT {SHARED}::DOUBLE / greatest({SHARED}, count(*) FILTER (seed = 'o' AND NOT held)) AS share FROM seeds),
places AS (SELECT seeds.*, unnest(range(length(t) + 1)) AS i FROM seeds),
grams AS MATERIALIZED (SELECT {grams} AS g, {', '.join(f"count(*) FILTER (NOT held AND seed = '{s}' AND NOT coalesce(i >= at_ AND i < at_ + length(rule), false)) AS {s}" for s in "aro")} FROM places GROUP BY 1),
{', '.join(orders)},
scored AS MATERIALIZED (SELECT g, round((ln(pr) - ln(pa)) * 1e9)::BIGINT AS llr FROM p{ORDER}),
scores AS MATERIALIZED (SELECT t, floor(sum(llr)::DOUBLE / (count(*) * {1e9 / SCALE})::DOUBLE)::BIGINT AS q FROM (SELECT t, {grams} AS g FROM (SELECT t, unnest(range(length(t) + 1)) AS i FROM (SELECT DISTINCT t FROM seeds))) JOIN scored USING (g) GROUP BY t),
bins AS (SELECT seed, q, count(*) AS n FROM (SELECT DISTINCT t, seed FROM seeds WHERE held AND seed IN ('a', 'o')) JOIN scores USING (t) GROUP BY ALL),
above AS (SELECT seed, q, coalesce(sum(n) OVER (PARTITION BY seed ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(n) OVER (PARTITION BY seed) AS total FROM bins),
cut AS (SELECT greatest(0, coalesce(max(q), 0)) AS threshold, (SELECT count(*) FILTER (seed = 'r' AND NOT held) > 0 AND count(*) FILTER (seed = 'a' AND NOT held) > 0 AND count(*) FILTER (seed <> 'r' AND held) > 0 FROM seeds) AS able
  FROM (SELECT seed, min(q) AS q FROM above WHERE above * 1000 <= CASE seed WHEN 'a' THEN {FALSE_BLOCKS} ELSE {OPEN_BLOCKS} END * total GROUP BY seed))
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN able AND q > threshold THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN q / {SCALE}::DOUBLE END AS llr
FROM rows_ LEFT JOIN scores USING (t), cut"""
