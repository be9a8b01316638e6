import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chunkgraph.llm import url_filter as uf
from tests.conftest import SF_SMALL


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for h, p, v in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, v)
    return best or (None, None)


def tree(rows, bad):
    """{(host, shape): (template, rejected)} by plain loops over (page_id, host, path)."""
    leaves = defaultdict(lambda: [0, 0, 0])
    for pid, host, path in rows:
        segs = tuple("*" if re.search(r"[0-9]", s) or len(s) > 40 else s for s in path.split("/") if s)
        leaf = leaves[host, segs]
        leaf[0] += 1
        if pid in bad:
            leaf[1] += 1
            leaf[2] += bad[pid]
    template = {k: () for k in leaves}
    for i in range(max((len(s) for _, s in leaves), default=0)):
        pages, children = Counter(), defaultdict(set)
        for (host, segs), (n, _, _) in leaves.items():
            if len(segs) > i:
                pages[host, template[host, segs]] += n
                children[host, template[host, segs]].add(segs[i])
        template = {(host, segs): tp if len(segs) <= i else tp + (
            "*" if len(children[host, tp]) >= max(10, 0.3 * pages[host, tp]) else segs[i],)
            for (host, segs), tp in template.items()}

    def parent(tp):
        fixed = [i for i, s in enumerate(tp) if s != "*"]
        return tp[:fixed[-1]] + ("*",) + tp[fixed[-1] + 1:] if fixed else tp

    def sums():
        t, pool = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for k, v in leaves.items():
            for d, key in ((t, template[k]), (pool, parent(template[k]))):
                d[k[0], key][0] += v[1]
                d[k[0], key][1] += v[2]
        return t, pool

    moved = True
    while moved:
        t, pool = sums()
        peers = Counter((host, len(tp)) for host, tp in t)
        to = {}
        for (host, tp), (n, b) in t.items():
            an, ab = pool[host, parent(tp)]
            rn, rb = an - n, ab - b
            differs = False
            if n and rn:
                s = ab / an
                spread = s * (1 - s) * (1 / n + 1 / rn)
                differs = spread > 0 and abs(b / n - rb / rn) > 1.96 * math.sqrt(spread)
            to[host, tp] = tp if differs or peers[host, len(tp)] < 2 else parent(tp)
        moved = any(k[1] != v for k, v in to.items())
        template = {k: to[k[0], tp] for k, tp in template.items()}
    t, pool = sums()
    hosts = defaultdict(lambda: [0, 0])
    for (host, _), (n, b) in t.items():
        hosts[host][0] += n
        hosts[host][1] += b
    all_n, all_b = sum(n for n, _ in hosts.values()), sum(b for _, b in hosts.values())
    base = all_b / all_n if all_n else 0.0
    out = {}
    for k in leaves:
        n, b = t[k[0], template[k]]
        if not n:
            n, b = pool[k[0], parent(template[k])]
        hn, hb = hosts[k[0]]
        purity = (b + 4 * (hb + 4 * base) / (hn + 4)) / (n + 4)
        out[k] = ("/".join(template[k]), hn > 0 and purity >= 0.5)
    return out


def expect(pages, bad):
    rows = [(p, *parts(u)) for p, u in pages]
    learnt = tree(rows, bad)
    out = Counter()
    for pid, host, path in rows:
        segs = tuple("*" if re.search(r"[0-9]", s) or len(s) > 40 else s for s in path.split("/") if s)
        template, rejected = learnt[host, segs]
        name, verdict = rule(host, path)
        out[pid, host, path, name, verdict or ("block" if rejected else "allow"), template] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "template"))
                   for r in df.collect())


def test_query_on_the_table(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    bad = {r.doc_id: int(r.quality == 0 or r.toxic == 1)
           for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert got(uf.op3_url_filter(spark, SF_SMALL)) == expect(pages, bad)


def test_learnt_tree_on_a_planted_site(spark):
    pages, labels = [], {}
    for i in range(300):
        kind = ("ads", "news", "blog")[i % 3]
        pages.append((i, f"http://site.org/{kind}/{'x' if i % 2 else 'y'}/{i}?q=1"))
        labels[i] = int(kind == "ads")
    pages += [(1000 + i, f"http://site.org/tag/{'abcdefghij'[i // 10]}word{'klmnopqrst'[i % 10]}x") for i in range(90)]
    pages += [(None, None), (2000, ""), (2001, "no scheme"), (2002, "http://SITE.org"), (2003, "x://h?a/b"),
              (2004, "http://a.net/es/" + "s/" * 300), (2004, "http://a.net/es/" + "s/" * 300), (2005, "://"),
              (2006, "http://www.EXAMPLE.com/en/1"), (2007, "http://notexample.com/en/1"), (2008, "ftp://net/fr/")]
    p = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1))
    lab = spark.createDataFrame([(k, 1 - v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    out = uf.filter_urls(p, lab)
    assert got(out) == expect(pages, labels)
    rows = {r.page_id: r for r in out.collect()}
    assert {rows[i].verdict for i in range(300) if i % 3 == 0} == {"block"}
    assert {rows[i].verdict for i in range(300) if i % 3} == {"allow"}
    assert rows[1000].template == "*/*" or rows[1000].template == "tag/*"


def word(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:04d}")


def deep_site(levels, host="deep.org"):
    """120 pages below free levels, 40 of them labelled, all bad; another host is clean."""
    pages = [(i, f"http://{host}/user/" + "/".join(word(7 * i + 131 * j) for j in range(levels))) for i in range(120)]
    labels = {i: 1 for i in range(0, 120, 3)}
    pages += [(1000 + i, f"http://fine.org/read/{word(i)}") for i in range(60)]
    labels |= {1000 + i: 0 for i in range(60)}
    return pages, labels


@pytest.mark.parametrize("levels", [1, 2, 5, 8])
def test_free_levels_below_free_levels(spark, levels):
    pages, labels = deep_site(levels)
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([(k, 1 - v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    out = uf.filter_urls(p, lab)
    assert got(out) == expect(pages, labels)
    verdicts = {r.page_id: r.verdict for r in out.collect()}
    assert {verdicts[i] for i in range(120)} == {"block"} and {verdicts[1000 + i] for i in range(60)} == {"allow"}


def test_unlabelled_templates_take_their_parents_share(spark):
    pages = [(i, f"http://bad.org/{'ab'[i % 2]}/{word(i)[:3]}/page") for i in range(8)]
    pages += [(100, "http://bad.org/other/where/page"), (101, "http://bad.org/elsewhere"), (102, "http://ok.org/a/b"),
              (103, "http://none.org/a")]
    pages += [(200 + i, f"http://clean.org/{word(i)}") for i in range(60)]
    labels = {i: 1 for i in range(8)} | {102: 0} | {200 + i: 0 for i in range(60)}
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([(k, 1 - v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    out = uf.filter_urls(p, lab)
    assert got(out) == expect(pages, labels)
    verdicts = {r.page_id: r.verdict for r in out.collect()}
    assert (verdicts[100], verdicts[101], verdicts[102], verdicts[103]) == ("block", "block", "allow", "allow")


def test_sql_agrees_on_random_sites(spark, tmp_path):
    import random

    import duckdb

    from chunkgraph.llm.oracles import ORACLES
    rnd = random.Random(8)
    pages, labels = [], {}
    for i in range(900):
        host = rnd.choice(["a.org", "b.org", "c.net"])
        segs = [rnd.choice([word(rnd.randint(0, 400)), rnd.choice("xyz"), "s"]) for _ in range(rnd.randint(0, 5))]
        pages.append((i, f"http://{host}/" + "/".join(segs)))
        if rnd.random() < 0.4:
            labels[i] = int(rnd.random() < (0.9 if "x" in segs else 0.2))
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([(k, 1 - v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    for df, name in ((p, "pages"), (lab, "labels")):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    out = uf.op3_url_filter(spark, str(tmp_path))
    assert got(out) == expect(pages, labels)
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    rows = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES['op3_url_filter']}) x").fetchall()
    assert sorted(rows, key=str) == sorted((tuple(r) for r in out.collect()), key=str)


def test_without_labels_and_empty_tables(spark):
    p = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/es/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in uf.filter_urls(p).collect()} == {1: "allow", 2: "block"}
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert uf.filter_urls(p, lab).count() == 2
    assert uf.filter_urls(p.limit(0), lab).count() == 0


@pytest.mark.parametrize("q", ["Python", "Arrow", "Cartesian"])
def test_plan_is_native(spark, q):
    assert q not in uf.op3_url_filter(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
