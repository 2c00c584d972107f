"""Verdicts on urls: rules by host and path, and trust carried along links where no rule fits.

A host starts with as much trust as it has pages that a rule allows, and as much distrust as it has pages that a rule
blocks. Trust walks along links (personalised PageRank from the trusted seeds), distrust against them, as a host that links
to blocked pages is to blame for it. Steps go on until no host's score changes by more than TOLERANCE of it, so that every
host that links lead to has its score; links within a host say nothing and do not count. A host is blocked if distrust makes up more than THRESHOLD of both; a host that neither reaches is allowed.

Links are read in Spark from the absolute and scheme-relative href values of the pages. Steps are equi joins of scores with
edges and sums per host; frequent hosts are reduced on the map side, and each step is written to the shared folder.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; a null html has no
links; repeated rows each get a row and count as pages of their own; an empty table gives no rows; other columns are
ignored; ties between trust and distrust (within TIE of their sum) allow.

The SQL ends after STEPS steps and has an absolute MARGIN, so it holds for graphs with short ways only.
"""
from pyspark.sql import functions as F

from coverlens.session import materialize

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
TOLERANCE = 1e-8
THRESHOLD = 0.5
TIE = 1e-6
#: Of the SQL only.
STEPS = 8
MARGIN = 1e-9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = "(?i)href\\s*=\\s*[\"']?([^\"'\\s>]+)"


def _after_scheme(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES):
    """(verdict, rule) structs of the longest rule that fits; null if none does."""
    found = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                    F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
             for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    return F.coalesce(*found)


def judged(pages, rules=RULES):
    """Pages with host, path and the rule that decides them."""
    out = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))


def host_edges(pages):
    """(src, dst, links) between different hosts."""
    absolute = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda u: u.contains("//"))
    link = pages.select(host_of(F.col("url")).alias("src"), F.explode(absolute).alias("href")).select(
        "src", host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href"))).alias("dst"))
    return (link.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst")
            .agg(F.count(F.lit(1)).alias("links")))


def spread(seeds, edges, damping=DAMPING, tolerance=TOLERANCE):
    """seeds: (host, kind, score), edges: (src, dst, links). Scores after the walks, kind 'trust' along, 'distrust' against."""
    edges = materialize(edges, "host-edges")
    out = edges.groupBy(F.col("src").alias("from")).agg(F.sum("links").alias("all"))
    back = edges.groupBy(F.col("dst").alias("from")).agg(F.sum("links").alias("all"))
    ways = (edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "links").join(out, "from").withColumn("kind", F.lit("trust"))
            .unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "links").join(back, "from")
                         .withColumn("kind", F.lit("distrust"))))
    ways = materialize(ways.select("from", "to", "kind", (F.lit(damping) * F.col("links") / F.col("all")).alias("share")), "host-ways")
    start = seeds.select("host", "kind", (F.lit(1 - damping) * F.col("score")).alias("score"))
    start = materialize(start.withColumn("before", F.lit(0.0)), "host-scores")
    now = start
    while not now.where(F.col("score") - F.col("before") > tolerance * F.col("score")).isEmpty():  # scores only grow
        moved = (ways.join(now.withColumnRenamed("host", "from"), ["from", "kind"])
                 .select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score"), F.lit(0.0).alias("before")))
        last = now.select("host", "kind", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        now = materialize(start.unionByName(moved).unionByName(last).groupBy("host", "kind")
                          .agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "host-scores")
    return now.drop("before")


def blocked_hosts(pages, rules=RULES, threshold=THRESHOLD):
    marked = judged(pages, rules).where("found is not null and host <> ''")
    seeds = (marked.groupBy("host", F.when(F.col("found.verdict") == "allow", "trust").otherwise("distrust").alias("kind"))
             .agg(F.count(F.lit(1)).alias("score")))
    scores = spread(seeds, host_edges(pages))
    trust = F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0))
    distrust = F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0))
    return (scores.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))
            .where(F.col("distrust") > (threshold + TIE) * (F.col("trust") + F.col("distrust"))).select("host"))


def verdicts(pages, rules=RULES):
    """One row per page: page_id, host, path, rule, verdict."""
    blocked = blocked_hosts(pages, rules).withColumn("blocked", F.lit(True))
    by_method = F.when(F.col("blocked"), "block").otherwise("allow")
    return (judged(pages, rules).join(blocked, "host", "left")
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce(F.col("found.verdict"), by_method).alias("verdict")))


def sql():
    """The same in SQL, the walk unrolled."""
    after = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = f"coalesce(translate(regexp_extract({after}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '')"
    path = f"coalesce(regexp_extract({after}, '^[^/?#]*([^?#]*)', 1), '')"
    fits = [(v, h + p, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')")
            for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    case = {k: "CASE " + " ".join(f"WHEN {c} THEN '{r[k]}'" for *r, c in fits) + " END" for k in (0, 1)}
    href = HREF.replace("'", "''")
    steps = []
    for k in range(STEPS):
        steps.append(f"""s{k + 1} AS MATERIALIZED (SELECT host, kind, sum(score) AS score FROM (
            SELECT * FROM s0 UNION ALL SELECT w.t, w.kind, s.score * w.share FROM ways w JOIN s{k} s ON s.host = w.f AND s.kind = w.kind)
            GROUP BY host, kind)""")
    return f"""
    WITH p AS MATERIALIZED (SELECT page_id, html, {host.format('url')} AS host, {path.format('url')} AS path FROM pages),
    j AS MATERIALIZED (SELECT page_id, host, path, {case[1]} AS rule, {case[0]} AS verdict FROM p),
    l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS href FROM p),
    d AS (SELECT src, CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END AS u FROM l),
    e AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM (SELECT src, {host.format('u')} AS dst FROM d)
        WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
    ways AS MATERIALIZED (
        SELECT src AS f, dst AS t, 'trust' AS kind, {DAMPING} * links / sum(links) OVER (PARTITION BY src) AS share FROM e UNION ALL
        SELECT dst, src, 'distrust', {DAMPING} * links / sum(links) OVER (PARTITION BY dst) FROM e),
    s0 AS MATERIALIZED (SELECT host, CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind,
        {1 - DAMPING!r}::DOUBLE * count(*) AS score FROM j WHERE verdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
    {", ".join(steps)},
    b AS (SELECT host FROM (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS tr,
        coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS di FROM s{STEPS} GROUP BY host) WHERE di - {THRESHOLD} * (tr + di) > {MARGIN!r}::DOUBLE)
    SELECT j.page_id, j.host, j.path, j.rule,
        coalesce(j.verdict, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM j LEFT JOIN b ON b.host = j.host"""
