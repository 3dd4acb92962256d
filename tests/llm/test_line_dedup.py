from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilspark.llm import line_dedup


def blank(x):
    return not x.strip(" \t\n\x0b\f\r")


def brute(rows, ratio, prior):
    pages = defaultdict(list)
    for _, host, text in rows:
        if text is not None:
            pages[host].append(text)
    common = {h: {x for x, n in Counter(x for p in ps for x in set(p.split("\n")) if not blank(x)).items() if n - 1 > ratio * (len(ps) - 1 + prior)} for h, ps in pages.items()}
    out = []
    for k, host, text in rows:
        if text is None:
            out.append((str(k), "None", 0))
            continue
        lines = text.split("\n")
        new = [x for x in lines if blank(x) or x not in common[host]]
        out.append((str(k), "\n".join(new), len(lines) - len(new)))
    return sorted(out)


def test_same_as_brute_force(docs):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for ratio, prior in ((0.05, 0), (0.4, 2), (0.02, 50)):
        got = line_dedup.dedup_lines(docs, F.col("source"), ratio=ratio, prior=prior)
        assert set(docs.columns) <= set(got.columns)
        assert sorted((str(r.doc_id), str(r.text), r.n_dropped) for r in got.collect()) == brute(rows, ratio, prior)
    assert any(x[2] for x in brute(rows, 0.05, 0))


def test_the_ratio_is_the_sites(spark):
    rows = [(i, "large", f"own {i}\n" + ("foot" if i < 30 else f"other {i}")) for i in range(400)]
    rows += [(1000 + i, "small", f"own {i}\n" + ("foot" if i < 2 else f"other {i}")) for i in range(10)]
    rows += [(2000, "one", "foot\nown")] + [(3000 + i, "half", "head\nhead" if i % 2 else f"page {i}") for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, source string, text string"), F.col("source")).collect()}
    assert got[3] == "own 3" and got[300] == "own 300\nother 300"  # 29 of 399 other pages
    assert got[1000] == "own 0\nfoot" and got[2000] == "foot\nown"  # few pages say little, a single one nothing
    assert got[3001] == "" and got[3000] == "page 0"  # a page keeps nothing if all of it is boilerplate


def test_host_of_address(spark):
    want = {
        "http://A.Example.com/x?y=//no": "a.example.com", "https://user:pw@m.site.org:8080": "m.site.org", "//cdn.site.org/a": "cdn.site.org", "http://[2001:db8::1]:80/": "[2001:db8::1]",
        "mailto:a@b.c": None, "/a/b": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "url string")
    assert {r.url: r.h for r in df.select("url", line_dedup.host_of(F.col("url")).alias("h")).collect()} == want
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert pages.select(line_dedup.host_of(F.col("url")).alias("h")).where("h not like '%.example.%'").count() == 0


def test_clashing_names(docs):
    named = docs.withColumnsRenamed({"key": "n_lines", "word": "n_dropped", "size": "pages", "row": "marks", "b": "m"})
    assert line_dedup.dedup_lines(named, F.col("source")).count() == docs.count()


def test_empty(empty):
    assert line_dedup.dedup_lines(empty, F.col("source")).count() == 0
