import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)


def test_entry_works_without_the_training_data_operators():
    out = run("import sys; sys.modules['lodestore.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))")
    n, has, subset = out.stdout.split()
    assert int(n) > 150 and has == "False" and subset == "True", out.stderr


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "lodestore")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "lodestore.llm" not in open(os.path.join(folder, n)).read(), n


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "section", "n_items", "tokens", "text"]
