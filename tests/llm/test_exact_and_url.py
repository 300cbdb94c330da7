import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, queries, url_filter
from helixframe.llm.components import min_label_components

from ..conftest import comparable
from .common import edge_documents, empty_documents


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, best):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    return sorted((str(r["doc_id"]), best([x for x in groups[lower(r["text"])] if x is not None], default=None), len(groups[lower(r["text"])])) for r in rows)


def test_exact_groups(spark):
    docs = edge_documents(spark)
    for keep, best in (("min", min), ("max", max)):
        got = exact_dedup.exact_groups(docs, keep=keep, prefix="_e_").collect()
        assert sorted((str(r["doc_id"]), r["_e_keep_id"], r["_e_group_size"]) for r in got) == brute(docs.collect(), best)
        assert all(r["_e_kept"] == (r["doc_id"] is not None and r["doc_id"] == r["_e_keep_id"]) for r in got)
    assert exact_dedup.exact_groups(empty_documents(spark)).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0")))
    docs = edge_documents(spark)
    got = exact_dedup.exact_groups(docs, keep="max", prefix="_e_").collect()
    assert sorted((str(r["doc_id"]), r["_e_keep_id"], r["_e_group_size"]) for r in got) == brute(docs.collect(), max)


def test_distinct_documents(spark):
    docs = edge_documents(spark)
    rows = docs.union(docs.where("doc_id is null or doc_id in (3, 6)"))
    got = exact_dedup.distinct_documents(rows)
    assert got.columns == docs.columns
    want = {}
    for r in docs.collect():
        want.setdefault(lower(r["text"]), []).append(r["doc_id"])
    assert sorted((r["doc_id"], lower(r["text"])) for r in got.collect()) == sorted((min(x for x in ids if x is not None), t) for t, ids in want.items())
    lone = spark.createDataFrame([(None, "a"), (None, "A"), (None, None), (1, "b")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in exact_dedup.distinct_documents(lone).collect()) == ["1", "None", "None"]
    assert exact_dedup.distinct_documents(empty_documents(spark)).count() == 0


def test_op2_matches_sql(spark, duck, sf):
    got = queries.op2_exact_dedup(spark, sf).toPandas()
    assert comparable(got) == comparable(duck.execute(queries.OP2_SQL).df())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.text_sha256 for r in got.itertuples()} == {k: hashlib.sha256(lower(t).encode()).hexdigest() for k, t in texts.items()}


def test_components(spark):
    import random

    r = random.Random(2)
    edges = [(f"n{r.randrange(200)}", f"n{r.randrange(200)}") for _ in range(150)] + [(f"c{k}", f"c{k + 1}") for k in range(60)] + [("hub", f"h{k}") for k in range(50)] + [(None, "a"), ("a", "a")]
    from helixframe.llm.common import shared_dir

    got = {x["id"]: x["label"] for x in min_label_components(spark.createDataFrame(edges, "a string, b string"), shared_dir(spark)).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def test_rules_and_aliases(spark):
    page = lambda head: f"<html><head>{head}</head><body>x</body></html>"
    rows = [
        (1, "http://a.example.ORG/es/1", None), (2, "https://example.org/en/12?x", ""), (3, "https://example.org/en/2", None), (4, "http://notexample.com/de/x", None),
        (5, "http://x.com/fr/1#y", None), (6, None, None), (7, "no scheme/de/", None), (8, "http://com/de/", None), (9, "http://x.org", None),
        # aliases: a page without a rule that redirects to a blocked one, and one that is canonical to it in turn
        (10, "http://q.net/1", page('<meta http-equiv="refresh" content="0; url=http://notexample.com/de/x">')), (11, "http://q.net/2", page('<link rel="canonical" href="/1">')),
        # allow takes precedence inside a component
        (12, "http://z.net/1", page('<link rel="canonical" href="http://notexample.com/de/y">')), (13, "http://notexample.com/de/y", None), (14, "http://z.org/ok", page('<link href="http://z.net/1" rel="canonical">')),
        (15, "https://www.z.net/1/?utm_source=f", None), (15, "https://www.z.net/1/?utm_source=f", None), (None, "http://alone.net/", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    got = sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, RULES).collect()))
    assert got == sorted([
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "example.org", "/en/2", "org/", "allow"), (4, "notexample.com", "/de/x", "com/de/", "block"),
        (5, "x.com", "/fr/1", "com/fr/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "com", "/de/", "com/de/", "block"), (9, "x.org", "", None, "allow"),
        (10, "q.net", "/1", None, "block"), (11, "q.net", "/2", None, "block"), (12, "z.net", "/1", None, "allow"), (13, "notexample.com", "/de/y", "com/de/", "block"), (14, "z.org", "/ok", "org/", "allow"),
        (15, "www.z.net", "/1/", None, "allow"), (15, "www.z.net", "/1/", None, "allow"), (0, "alone.net", "/", None, "allow"),
    ])
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0


def test_links_of():
    page = "http://h.net/a/b/c?d=1#e"
    meta = '<meta http-equiv="Refresh" content="{}">'.format
    link = "<link rel='canonical' href='{}'>".format
    for html, want in [
        (link("y"), ["http://h.net/a/b/y"]), (link("../y"), ["http://h.net/a/y"]), (link("?p=1"), ["http://h.net/a/b/c?p=1"]), (link("//o.org/z"), ["http://o.org/z"]), (link("/r?x=1&amp;y=2"), ["http://h.net/r?x=1&y=2"]),
        (meta("0; url=next"), ["http://h.net/a/b/next"]), (meta("3;URL='/q r'"), ["http://h.net/q r"]), (meta("5"), []), (meta("0, https://s.org/"), ["https://s.org/"]),
        ('<base href="http://o.com/k/l">' + link("m") + link("n"), ["http://o.com/k/m", "http://o.com/k/n"]), ('<LINK HREF=z REL="nofollow Canonical"/>', ["http://h.net/a/b/z"]),
        ("<!-- " + link("y") + " -->", []), ("<script>var x = '" + link("y").replace("'", '"') + "'</script>", []), (link("mailto:a@b.c"), []), (link("http://[bad"), []), ("<link rel=canonical>", []),
        ("x" * 300_000 + link("y") + "<" * 1000, ["http://h.net/a/b/y"]),
    ]:
        assert url_filter.links_of(page, html) == want, html[-80:]


def test_aliases_equal_brute_force_over_pages(spark, sf):
    """All of pages, with redirect chains, stars and canonical links planted in every spelling of a reference."""
    import random

    r = random.Random(8)
    rows = [(x["page_id"], x["url"], x["html"] or "") for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").orderBy("page_id").collect()]
    rows += [(10**6 + k, f"http://c{k % 7}.net/p/{k}?v={k}", "") for k in range(300)]
    rows += [(2 * 10**6 + k, f"http://s{k % 5}.{r.choice(['com', 'com', 'org'])}/{r.choice(['de', 'de', 'fr'])}/{k}", "") for k in range(200)]
    key = lambda u: u.split("#")[0].lower() if u and "://" in u else None
    top = {key(u): key(u) for _, u, _ in rows if key(u)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    def refer(a, b):
        (sa, ha), (sb, hb) = ((u.split("://")[0], u.split("://")[1].split("/")[0]) for u in (a, b))
        return r.choice([b, b + "#part", *([b[len(sb) + 1 :]] if sa == sb else []), *([b[len(sb) + 3 + len(hb) :]] if (sa, ha) == (sb, hb) else [])]).replace("&", "&amp;")

    planted = []
    for n, (i, u, h) in enumerate(rows):
        if u and "://" in u and "/" in u.split("://")[1] and (10**6 <= i < 2 * 10**6 or r.random() < 0.05):
            to = rows[n - 1][1] if i >= 10**6 and i % 20 else r.choice(rows[-200:] if i >= 10**6 else rows)[1]
            if to and "://" in to and "/" in to.split("://")[1]:
                ref = refer(u, to)
                h += r.choice([f'<link rel="canonical" href="{ref}">', f"<meta http-equiv=refresh content='1; url={ref}'>"])
                a, b = find(key(u)), find(key(to))
                top[max(a, b)] = min(a, b)
        planted.append((i, u, h))
    fits = lambda host, path, rule: (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])
    direct, marks = {}, defaultdict(set)
    for i, u, _ in planted:
        rest = u.split("://", 1)[1].split("?")[0].split("#")[0] if u and "://" in u else ""
        host, path = rest.split("/", 1)[0].lower(), rest[len(rest.split("/", 1)[0]) :]
        best = max(((len(x), v) for v, x in RULES if fits(host, path, x)), default=None)
        direct[i] = best and best[1]
        if best and key(u):
            marks[find(key(u))].add(best[1])
    want = {i: direct[i] or ("block" if key(u) and marks[find(key(u))] == {"block"} else "allow") for i, u, _ in planted}
    df = spark.createDataFrame(planted, "page_id long, url string, html string").repartition(5)
    got = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(df, RULES).collect()}
    assert got == want
    assert sum(1 for i in want if not direct[i] and want[i] == "block") > 20


def test_shared_folders_are_swept(spark):
    import os

    from helixframe.llm.common import shared_dir, swept, written

    kept = written(spark.range(3), shared_dir(spark), "kept")
    with swept(spark):
        folder = shared_dir(spark)
        written(spark.range(5), folder, "gone")
        assert os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 3
