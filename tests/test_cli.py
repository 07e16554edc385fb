import json

from gleaner import cli
from tests.conftest import SMALL


def test_pipeline(spark, tmp_path, capsys):
    t = str(tmp_path)
    (tmp_path / "q.tsv").write_text("1\tmuseum tubingen\n2\tthe and\n")
    assert cli.main(["preprocess", "--input", f"{SMALL}/raw_pages.parquet", "--output", f"{t}/docs"]) == 0
    assert cli.main(["index", "--input", f"{t}/docs", "--output", f"{t}/index", "--buckets", "4"]) == 0
    assert cli.main(["--summary-output", f"{t}/s.json", "batch", "--input", f"{t}/q.tsv", "--index", f"{t}/index", "--output", f"{t}/r.tsv", "--top-k", "5"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert out[0]["num_pages"] == out[1]["num_docs"] > 0
    rows = [x.split("\t") for x in (tmp_path / "r.tsv").read_text().splitlines()]
    assert 0 < len(rows) <= 5 and all(r[0] == "1" and len(r) == 4 for r in rows)
    assert json.loads((tmp_path / "s.json").read_text())["query_count"] == 2


def test_crawl_resumes(spark, tmp_path, capsys):
    page = "<html lang=en><title>T</title>the town of tuebingen and the river in the valley<a href='/{0}'>x</a>"
    web = [(f"https://a.de/{i}", 200, "text/html", page.format(i + 1)) for i in range(6)]
    spark.createDataFrame(web, "url string, status int, content_type string, html string").write.parquet(str(tmp_path / "web"))
    (tmp_path / "seeds.json").write_text(json.dumps({"seeds": ["https://a.de/0"]}))
    args = ["crawl", "--seeds", str(tmp_path / "seeds.json"), "--web", str(tmp_path / "web"), "--output", str(tmp_path / "out"), "--checkpoint-every", "100"]
    cli.main([*args, "--max-pages", "2", "--fresh"])
    cli.main([*args, "--max-pages", "4"])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(o["total_pages"], o["runs_completed"], o["started_fresh_last_run"]) for o in out] == [(2, 1, True), (4, 2, False)]
