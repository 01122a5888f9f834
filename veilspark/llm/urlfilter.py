"""URL filter: rules, and a character language-model ratio for what no rule judges.

Urls that rules accept and reject train one smoothed variable-order Markov model
each: Witten-Bell interpolation of the orders 0 to `order`, so a context that a class
has never seen falls back on shorter ones. A url's score is the mean, over its
characters, of log P(accepted model) - log P(rejected model); scores under a
threshold are blocked. One in five of the ruled urls, by hash, trains nothing; the threshold is the
score that splits these held-out urls with the least sum of both error rates, in the middle of the gap between theirs.

Counts are aggregated by character n-gram before they move; scores are computed
once for each distinct host and path. The table of log ratios, a row for each n-gram, is broadcast while it has at most
`MAX_RATIOS` rows, and joined by a shuffle beyond; a url's characters meet again in their own task.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, put

# The rules as (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
PAD = "\u0001"
HELD_OUT_SHARE = 5  # one in so many
MAX_RATIOS = 500_000  # some 30 MB
STEP, MOST = 0.01, 2000  # of the threshold's histogram


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path; both empty without `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, order: int) -> Column:
    """Each character with the `order` characters before it; PAD stands before the start and once after the end."""
    padded = F.concat(F.lit(PAD * order), text, F.lit(PAD))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio) from (gram, accepted, rejected): one row for each gram, its log probability ratio given its context."""
    sides = ("accepted", "rejected")
    known = None
    for k in range(order + 1):
        level = grams.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(*(F.sum(s).alias(s) for s in sides))
        level = level.withColumn("h", F.expr(f"left(g, {k})"))
        context = level.groupBy("h").agg(*(f(s).alias(f"{n}_{s}") for s in sides for n, f in (("sum", F.sum), ("kinds", lambda c: F.sum((F.col(c) > 0).cast("long"))))))
        level = level.join(context, "h").withColumn("lower", F.expr(f"right(g, {k})"))
        if known is None:
            level = level.withColumns({f"q_{s}": F.lit(1 / 256) for s in sides})
        else:
            level = level.join(known, "lower")
        probability = {f"p_{s}": F.when(F.col(f"sum_{s}") == 0, F.col(f"q_{s}")).otherwise((F.col(s) + F.col(f"kinds_{s}") * F.col(f"q_{s}")) / (F.col(f"sum_{s}") + F.col(f"kinds_{s}"))) for s in sides}
        level = level.withColumns(probability)
        known = level.select(F.col("g").alias("lower"), *(F.col(f"p_{s}").alias(f"q_{s}") for s in sides))
    return known.select(F.col("lower").alias("gram"), (F.log("q_accepted") - F.log("q_rejected")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, order: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, score; a row for each row of `pages`.

    A null url and one without `://` have an empty host and path; the method judges
    them by the empty text's score. `score` is null where a rule decides. Without accepted or without rejected training
    urls everything that no rule judges is allowed. Repeated rows repeat; a null id
    stays null. Other columns are not read; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    text = F.concat("host", "path")
    held = (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int") % HELD_OUT_SHARE == 0).alias("held")
    places = put(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.first("ruled").alias("ruled")).select("*", F.lower(text).alias("text"), held), "places")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = places.repartition(parts).select("host", "path", "ruled", "held", "n", F.explode(_grams(F.col("text"), order)).alias("gram"))
    trains = lambda says: F.sum(F.when((F.col("ruled") == says) & ~F.col("held"), F.col("n")).otherwise(0))
    grams = put(each.groupBy("gram").agg(trains("allow").alias("accepted"), trains("block").alias("rejected")), "grams")
    ratios = put(log_ratios(grams, order), "ratios")
    small = F.broadcast(ratios) if ratios.count() <= MAX_RATIOS else ratios
    mean = F.round(F.sum("ratio") / F.count(F.lit(1)), 6) + F.lit(0.0)
    scored = put(each.join(small, "gram").groupBy("host", "path").agg(mean.alias("score"), *(F.first(c).alias(c) for c in ("ruled", "held", "n"))), "scores")
    drop(places, grams, ratios)
    bound = threshold(scored)
    found = F.when(F.lit(bound is not None) & (F.col("score") < F.lit(bound if bound is not None else 0.0)), "block").otherwise("allow")
    judged = scored.filter("ruled is null").select("host", "path", "score", found.alias("method"))
    return (
        rows.join(judged, ["host", "path"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"), "score")
    )


def threshold(scored: DataFrame) -> float | None:
    """The multiple of `STEP` with the least sum of error rates on the held-out ruled urls, or on all ruled ones where the held-out are of one kind; null without urls of both kinds. Bins bound what comes to the driver."""
    bin_ = F.greatest(F.least(F.floor(F.col("score") / STEP), F.lit(MOST)), F.lit(-MOST)).cast("int")
    every = scored.filter("ruled is not null").groupBy("held", bin_.alias("bin")).agg(*(F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block"))).collect()
    bins = [r for r in every if r["held"]]
    if not sum(r["allow"] for r in bins) or not sum(r["block"] for r in bins):
        bins = every
    by: dict[int, list[int]] = {}
    for r in bins:
        pair = by.setdefault(r["bin"], [0, 0])
        pair[0] += r["allow"]
        pair[1] += r["block"]
    rows = sorted((b, *v) for b, v in by.items())
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return None
    best, wrong, before = None, (0, block), None
    for at, a, b in rows:
        loss = wrong[0] / allow + wrong[1] / block
        if best is None or loss < best[0]:
            best = (loss, (at if before is None else (before + 1 + at) // 2) * STEP)
        wrong, before = (wrong[0] + a, wrong[1] - b), at
    return best[1]


def _oracle(order: int = 3) -> str:
    """`judge` in DuckDB SQL, over the table `pages`."""
    ruled = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda text: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*text.split("/", 1))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in ruled) + " END"
    levels = []
    for k in range(order + 1):
        below, q = (f"JOIN p{k - 1} l ON right(c.g, {k}) = l.g", ("l.pa", "l.pr")) if k else ("", ("1.0/256", "1.0/256"))
        prob = lambda s, q: f"CASE WHEN s{s} = 0 THEN {q} ELSE (c.{s} + k{s} * {q}) / (s{s} + k{s}) END AS p{s}"
        levels.append(f"""c{k} AS (SELECT right(gram, {k + 1}) AS g, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM grams GROUP BY 1),
        h{k} AS (SELECT left(g, {k}) AS h, sum(a) AS sa, count(*) FILTER (a > 0) AS ka, sum(r) AS sr, count(*) FILTER (r > 0) AS kr FROM c{k} GROUP BY 1),
        p{k} AS (SELECT c.g, {prob("a", q[0])}, {prob("r", q[1])} FROM c{k} c JOIN h{k} h ON left(c.g, {k}) = h.h {below})""")
    return f"""WITH cut AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
    named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
    split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
    told AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM split),
    places AS (SELECT host, path, any_value(ruled) AS ruled, count(*) AS n, lower(host || path) AS text, ('0x' || substr(md5(host || path), 1, 6))::INT % {HELD_OUT_SHARE} = 0 AS held FROM told GROUP BY host, path),
    each AS (SELECT host, path, ruled, held, n, substr(repeat(chr(1), {order}) || text || chr(1), i::INT, {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM places)),
    grams AS (SELECT gram, sum(CASE WHEN ruled = 'allow' AND NOT held THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' AND NOT held THEN n ELSE 0 END) AS r FROM each GROUP BY gram),
    {", ".join(levels)},
    scored AS (SELECT host, path, any_value(ruled) AS ruled, any_value(held) AS held, any_value(n) AS n, round(sum(ln(pa) - ln(pr)) / count(*), 6) + 0.0::DOUBLE AS score FROM each JOIN p{order} ON gram = g GROUP BY host, path),
    known AS (SELECT * FROM scored WHERE ruled IS NOT NULL AND (held OR (SELECT count(DISTINCT ruled) FROM scored WHERE held AND ruled IS NOT NULL) < 2)),
    bins AS (SELECT greatest(least(floor(score / {STEP}), {MOST}), -{MOST}) AS bin, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END)::DOUBLE AS r FROM known GROUP BY 1),
    losses AS (SELECT bin, coalesce(floor((lag(bin) OVER w2 + 1 + bin) / 2), bin) AS cut, coalesce(sum(a) OVER w, 0) / (SELECT sum(a) FROM bins) + ((SELECT sum(r) FROM bins) - coalesce(sum(r) OVER w, 0)) / (SELECT sum(r) FROM bins) AS loss FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (ORDER BY bin)),
    bound AS (SELECT cut * {STEP} AS least FROM losses WHERE (SELECT count(DISTINCT ruled) FROM known) = 2 ORDER BY loss, bin LIMIT 1)
    SELECT page_id, t.host, t.path, t.rule, coalesce(t.ruled, CASE WHEN s.score < (SELECT least FROM bound) THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN t.ruled IS NULL THEN s.score END AS score
    FROM told t JOIN scored s ON t.host = s.host AND t.path = s.path"""


ORACLE = _oracle()
