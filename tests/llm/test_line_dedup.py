from cohortspark.llm.line_dedup import drop_site_lines

SCHEMA = "page_id long, url string, html string"


def page(i, *lines):
    return f"<html><head><title>t {i}</title></head><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def by_id(df):
    return {r["page_id"]: r for r in df.collect()}


def test_drops_boilerplate_of_its_host_only(spark, clashing):
    rows = [(i, "http://www.Site.org/a", page(i, "menu", f"own {i}", "menu")) for i in range(6)]
    rows += [(10 + i, "https://other.org:80/b?x#y", page(i, "menu" if i < 2 else f"m {i}", f"own {i}")) for i in range(8)]
    rows += [(30, None, page(1, "menu")), (31, "no host", page(1, "menu")), (32, "http://site.org", None)]
    found = by_id(drop_site_lines(clashing(spark.createDataFrame(rows, SCHEMA)), ratio=0.3))
    assert all(found[i]["kept_text"] == f"own {i}" and found[i]["n_dropped"] == 2 for i in range(6))
    assert found[10]["kept_text"] == "menu\nown 0" and found[10]["host"] == "other.org"
    assert found[30]["kept_text"] == found[31]["kept_text"] == "menu" and found[30]["host"] is None
    assert found[32]["kept_text"] is None and found[32]["n_lines"] == 0


def test_ratio_counts_pages_not_lines(spark):
    rows = [(i, "http://a.b/", page(i, *["twice"] * 9) if i < 3 else page(i, f"x {i}")) for i in range(10)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert by_id(drop_site_lines(frame, ratio=0.3))[0]["n_dropped"] == 0  # 3 of 10 is not more than 0.3
    assert by_id(drop_site_lines(frame, ratio=0.29))[0]["n_dropped"] == 9


def test_small_hosts_repeated_rows_and_hidden_text(spark):
    rows = [(1, "http://a.b/", "<script>x</script>one<br/>two<!-- c --> <b>three</b>\n\n four<li>five")] * 4
    found = drop_site_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["kept_text"] for r in found} == {"one\ntwo three\nfour\nfive"} and len(found) == 4


def test_empty_table(spark):
    assert drop_site_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_of_a_page_are_taken_once(spark, monkeypatch):
    from cohortspark.llm import line_dedup

    uses, plain = [], line_dedup.lines_of
    monkeypatch.setattr(line_dedup, "lines_of", lambda html: uses.append(1) or plain(html))
    rows = [(i, f"http://a.b/{i}", f"<p>menu</p><p>page {i}</p>", "more") for i in range(6)] + [(6, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, other string")
    whole = line_dedup.drop_site_lines(pages)
    assert len(uses) == 1
    assert whole.columns == ["page_id", "url", "html", "other", "host", "n_lines", "n_dropped", "kept_text"]
    assert [tuple(r)[:4] for r in whole.orderBy("page_id").collect()] == rows
    few = line_dedup.drop_site_lines(pages, keep=["page_id"])
    assert few.columns == ["page_id", "host", "n_lines", "n_dropped", "kept_text"]
    assert sorted(tuple(r) for r in few.collect())[0] == (0, "a.b", 2, 1, "page 0")
    assert few.where("page_id = 6").first()["kept_text"] is None
