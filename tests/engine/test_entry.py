import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_names_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("quarrylight", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 20 and not [n for n in q if n.startswith('op') or n == 'pipeline'], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "quarrylight").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quarrylight\.llm|from \.+llm|import llm", path.read_text()), path


def test_smoke(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "pos", "repo", "doc_id", "rerank_score", "effective_score"] and rows.count() == 8 * 2  # documents 0 and 100 ask
