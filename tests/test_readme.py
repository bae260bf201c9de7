"""The README's usage block runs as written (paths bound to local copies of the test data)."""

import re

from faultlens.session import scratch_path
from faultlens.sources import fixtures as fx
from faultlens.sources import logstore as ms_pages
from faultlens.sources import metricstore as ms

SF = "/root/testdata/sf0.001"


def test_readme_usage_block(spark, tmp_path):
    readme = open(__file__.rsplit("/tests/", 1)[0] + "/README.md").read()
    code = re.search(r"```python\n(from faultlens.functions.time import from_epoch_micros.*?)```", readme, re.S).group(1)
    log_dir = tmp_path / "logs"
    log_dir.mkdir()
    for i, r in enumerate(fx.raw_log(spark, SF).where("filename LIKE '%application_%'").limit(200).collect()):
        folder = log_dir / r.filename.strip("/").replace("/", "_")
        folder.mkdir(exist_ok=True)
        with open(folder / "part.log", "a") as fh:
            fh.write(r.line + "\n")
    text_dir = tmp_path / "text"
    text_dir.mkdir()
    (text_dir / "a.txt").write_text("the quick brown fox\njumps over the lazy dog\n")
    store_dir = scratch_path(spark, "readme_store")
    fx.raw_log(spark, SF).write.parquet(store_dir)
    pages_dir = scratch_path(spark, "readme_pages")
    ms_pages.envelope_lines(ms.metric_responses(fx.metric_sample(spark, SF))).write.text(pages_dir)
    env = {"spark": spark, "LOG_DIR": str(log_dir), "TEXT_DIR": str(text_dir), "STORE_DIR": store_dir,
           "OUT_DIR": scratch_path(spark, "readme_out"), "PAGES_DIR": pages_dir}
    exec(compile(code, "README.md", "exec"), env)
    assert env["records"].count() > 0 and env["words"].count() == 8
    assert env["dataset"].count() > 0 and env["rates"].count() > 0
    assert env["gaps"].count() >= 0
