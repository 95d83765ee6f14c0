"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams, in DataFrame and SQL
functions only.

The model is trained in Spark from a small labelled table (at most MOST rows, in the order of their hashes): n-grams of host and path are hashed into
BUCKETS, the inner products of all labelled URLs are joined up, and gradient steps with momentum in the dual run in one higher-order
aggregate over that matrix. The weights of the buckets (bounded by BUCKETS) come back as one array, a constant of the
scoring projection, so that pages are scored row by row without a join or a shuffle and carry no weights along.

What it learns is which words make up the names of the labelled table; a name of none of these words, or of parts of them,
tells it little (measured in tests/llm/test_url_filter.py).

Rules: one fits its host and all subdomains, for paths that begin with its own; the longest wins, of equally long ones
(host and path together) the one that comes first.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the model's
intercept and the marked ends of nothing alone; of equally long rules the first holds, however many there are; urls of any length are read whole; repeated rows are judged one by one;
an empty table gives an empty result; columns named like those of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS, BUCKETS = (3, 4, 5), 1 << 16
STEPS, RATE, DECAY, MOST = 60, 0.02, 0.01, 700
#: The probability from which a page is blocked.
BLOCK_AT = 0.6
#: A rule for each of up to this many becomes a case of an expression; more are joined by the suffixes of hosts.
CASES = 200

#: The labelled table is made by rule from these lists: words that tell sites to block, words of other sites, and what
#: both have in common - what a name is put together with, ends of hosts and paths - so that only the words tell them
#: apart. None of it is taken from a table of pages.
BLOCKED = (
    "casino poker roulette slots blackjack jackpot lottery betting bets gambling bookmaker viagra cialis pills pharmacy steroids "
    "porn xxx sex adult escort nude camgirls hentai fetish payday loans debt ponzi forex "
    "warez torrent keygen crack cheats spam scam phishing malware spyware replica counterfeit adserver adclick popads banners tracker"
).split()
ALLOWED = (
    "news weather library university museum science history garden music sport travel recipes research archive maps health docs wiki forum school "
    "council theatre cinema poetry letters study community journal market water data city software bank hotel hospital bakery painting radio "
    "climate energy physics biology chemistry maths robotics network linux python compiler kernel editor github stack academy gallery festival church "
    "railway airport harbour mountain river forest cycling football running chess camera phone printer laptop cloud mail search calendar photos video "
    "tickets jobs housing insurance taxes justice parliament ministry embassy police fire rescue charity volunteer family children parents teacher "
    "flowers coffee wine cheese bread kitchen furniture fashion shoes jewellery books comics podcast magazine tribune gazette herald chronicle"
).split()
_WITH = "my best top the online world live hub now zone club pro plus express star king central point first direct".split()
_SHAPES = ("{w}", "{x}{w}", "{w}{x}", "{x}-{w}", "{w}-{x}", "{w}{n}")
_BEFORE = ("", "www.", "", "m.", "blog.", "shop.")
_ENDS = ("com", "org", "net", "info", "co.uk", "de", "fr", "es", "io", "dev", "edu", "eu", "example.com", "example.org", "example.net")
_PATHS = ("/", "", "/index.html", "/about", "/en/12", "/de/417.html", "/fr/7/", "/es/3105", "/2021/04/item", "/p/88", "/list/page/2", "/en/contact", "/a/b/c.php", "/docs/start")

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def labelled_rows() -> list[tuple[str, str, int]]:
    """(host, path, y), at most MOST: 1 is to be blocked. Words take turns with shapes, ends and paths; a
    blocked word makes a name to be blocked, whatever word of the other list it stands with."""
    rows = []
    for y, words, times in ((1, BLOCKED, 6), (0, ALLOWED, 3)):
        r = 0
        for k, w in enumerate(words):
            for n in range(times):
                x = ALLOWED[11 * r % len(ALLOWED)] if y and n % 2 else ALLOWED[(17 * r + 5) % len(ALLOWED)] if not y and n == 2 else _WITH[3 * r % len(_WITH)]
                name = _SHAPES[(k + n) % len(_SHAPES)].format(w=w, x=x, n=7 * r % 90 + 10)
                rows.append((f"{_BEFORE[(k + n) % len(_BEFORE)]}{name}.{_ENDS[r % len(_ENDS)]}", _PATHS[5 * r % len(_PATHS)], y))
                r += 1
            if k % 4 == 0:  # the word in the path of a host that says nothing
                rows.append((f"{_WITH[k % len(_WITH)]}{k}.{_ENDS[k % len(_ENDS)]}", f"/{w}/{k}", y))
    return rows[:MOST]


def labelled(spark: SparkSession) -> DataFrame:
    """(host, path, y): 1 is to be blocked."""
    return spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', {y})" for h, p, y in labelled_rows()) + " as t(host, path, y)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def buckets(host: str = "host", path: str = "path", grams: tuple[int, ...] = GRAMS, size: int = BUCKETS) -> Column:
    """The buckets of all n-grams of host and path, each with its ends marked."""
    return F.concat(*(_grams(name, kind, n, size) for kind, name in enumerate((host, path)) for n in grams))


def _grams(name: str, kind: int, n: int, size: int) -> Column:
    # letters by place in an array: to cut an n-gram out of a long url would cost a walk up to its place
    letters = F.concat(F.array(F.lit("^")), F.filter(F.split(name, ""), lambda c: c != ""), F.array(F.lit("$")))

    def of(at: Column) -> Column:
        bucket = lambda i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*(F.get(at, i + o) for o in range(n)))), F.lit(size)).cast("int")
        return F.when(F.size(at) >= n, F.transform(F.sequence(F.lit(0), F.size(at) - n), bucket)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.array(letters), of))  # a lambda over an array of one, so that the letters are split once


def model(known: DataFrame, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """One row: w, the weight of every bucket and at last the intercept. known: (host, path, y)."""
    rows = known.select("host", "path", F.col("y").cast("double").alias("y")).where("host is not null and path is not null and y is not null").orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(MOST)
    rows = rows.withColumn("b", buckets()).withColumn("i", F.row_number().over(_all().orderBy("host", "path", "y")))
    counts = rows.select("i", F.size("b").alias("m"), F.explode("b").alias("b")).groupBy("i", "m", "b").agg(F.count("*").alias("c")).select("i", "b", (F.col("c") / F.sqrt("m")).alias("v"))
    left, right = counts.alias("l"), counts.alias("r")
    products = left.join(right, F.col("l.b") == F.col("r.b")).groupBy(F.col("l.i").alias("i"), F.col("r.i").alias("j")).agg(F.sum(F.col("l.v") * F.col("r.v")).alias("k"))
    lines = products.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("line"))
    table = rows.select("i", "y").join(lines, "i", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "line"))).alias("t"))
    table = table.where("size(t) > 0").select(F.col("t.y").alias("y"), F.transform("t", lambda r: F.coalesce(r["line"], F.slice(F.get("t", F.lit(0))["line"], 1, 0))).alias("k"))
    nothing = F.transform("y", lambda _: F.lit(0.0))

    def step(state: Column, k: Column) -> Column:
        ahead = F.zip_with(state["now"], state["before"], lambda a, b: a + k / (k + 3) * (a - b))

        def moved(ahead: Column) -> Column:
            # the intercept is a feature of every row: it adds 1 to all products, and so the sum of all to each margin
            every = F.aggregate(ahead, F.lit(0.0), lambda s, x: s + x)
            margins = lambda every: F.transform("k", lambda line: F.aggregate(line, every, lambda s, x: s + x["k"] * F.get(ahead, x["j"] - 1)))
            gain = F.get(F.transform(F.array(every), lambda e: F.zip_with("y", margins(e), lambda y, m: y - 1.0 / (1.0 + F.exp(-m)))), F.lit(0))
            return F.zip_with(ahead, gain, lambda old, g: old * (1.0 - rate * decay) + rate * g)

        return F.struct(F.get(F.transform(F.array(ahead), moved), F.lit(0)).alias("now"), state["now"].alias("before"))

    final = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.struct(nothing.alias("now"), nothing.alias("before")), step, lambda s: s["now"])
    duals = table.select(F.posexplode(final).alias("i", "a")).select((F.col("i") + 1).alias("i"), "a")
    weights = counts.join(duals, "i").groupBy("b").agg(F.sum(F.col("v") * F.col("a")).alias("w"))
    weights = weights.union(duals.agg(F.lit(BUCKETS).alias("b"), F.sum("a").alias("w")))
    every = known.sparkSession.range(BUCKETS + 1).select(F.col("id").cast("int").alias("b")).join(weights, "b", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("ws")).select(F.transform("ws", lambda x: x["w"]).alias("w"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # of at most MOST rows


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages, which has host and path, with rule and rule_verdict."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fit = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    if len(ordered) <= CASES:
        best = F.coalesce(*(F.when(fit(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered)) if ordered else F.lit(None).cast("struct<rule:string,verdict:string>")
        return pages.withColumn("_best", best).select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))
    table = pages.sparkSession.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}', {k})" for k, (h, p, v) in enumerate(ordered)) + " as t(rule_host, rule_path, v, place)")
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("host", "\\."))), lambda k: F.array_join(F.slice(F.split("host", "\\."), k, F.lit(1 << 20)), "."))
    hosts = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(ends))
    found = hosts.join(table, "rule_host").where("startswith(path, rule_path)").groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("v").alias("verdict")), F.struct(F.length("rule_host") + F.length("rule_path"), -F.col("place"))).alias("_best"))
    return pages.join(found, ["host", "path"], "left").select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def judged(pages: DataFrame, known: DataFrame | None = None, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and p_block; these replace columns of such names."""
    names = ("host", "path", "rule", "verdict", "p_block")
    kept = [c for c in pages.columns if c not in names]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), host.alias("host"), path.alias("path"))
    w = model(labelled(pages.sparkSession) if known is None else known).first().w or [0.0] * (BUCKETS + 1)
    weights = F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")  # of literals alone: made once, when the plan is optimised
    rows = ruled(rows, rules).withColumn("_b", buckets())
    total = F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.get(weights, b))
    z = total / F.sqrt(F.greatest(F.size("_b"), F.lit(1))) + F.lit(w[BUCKETS])
    out = rows.withColumn("p_block", 1.0 / (1.0 + F.exp(-z)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow"))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in kept), "host", "path", "rule", verdict.alias("verdict"), "p_block")
