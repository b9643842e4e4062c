"""What the driver reads."""

import __spark_entry__


def test_entry_and_its_tables(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["source_id", "target_id", "source_url", "target_url", "similarity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_operators_do_not_name_the_optional_subpackage():
    import pathlib

    import weftline

    root = pathlib.Path(weftline.__file__).parent
    rest = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert rest and not [p for p in rest if "weftline.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
