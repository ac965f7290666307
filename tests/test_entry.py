import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_keys():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)


def test_core_imports_without_llm():
    from pathlib import Path

    for p in Path(entry.__file__).parent.glob("tidemark/**/*.py"):
        if "llm" not in p.parts:
            assert "tidemark.llm" not in p.read_text()
