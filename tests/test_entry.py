"""The entry module, also where the llm folders are gone."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(at):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=at, capture_output=True, text=True, check=True, timeout=120)
    return json.loads(out.stdout.splitlines()[-1])


def test_without_the_llm_folders(tmp_path):
    for keep_pipeline in (True, False):
        at = tmp_path / str(keep_pipeline)
        at.mkdir()
        shutil.copytree(REPO / "lethe", at / "lethe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(REPO / "__spark_entry__.py", at)
        if keep_pipeline and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", at)
        queries, sql = names(at)
        assert "token_table" in queries and not [q for q in queries if q.startswith("op") or q == "pipeline"]
        assert set(sql) <= set(queries)


def test_an_empty_folder_left_behind(tmp_path):
    shutil.copytree(REPO / "lethe", tmp_path / "lethe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lethe" / "llm").mkdir()
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    assert "token_table" in names(tmp_path)[0]
