import __spark_entry__ as E

from changelens.plans import catalog

SMOKE = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"discrepancy", "file_type", "n"}
    assert df.count() >= 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark):
    for k in ["diff_discrepancy_report", "bleu", "code_change_metrics", "keyword_any_filter", "line_delta"]:
        p = _plan(E.queries()[k](spark, SMOKE))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p, k


def test_filter_and_pruning_reach_the_scan(spark):
    p = _plan(E.queries()["row_cap"](spark, SMOKE))
    assert "PushedFilters" in p
    p = _plan(E.queries()["project_reorder"](spark, SMOKE))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in p


def test_done_anti_join_plans_an_anti_join(spark):
    p = _plan(E.queries()["done_anti_join"](spark, SMOKE))
    assert "LeftAnti" in p


def test_miner_gathers_no_commit_in_a_window(spark):
    assert "Window" not in _plan(E.queries()["mine_bug_fix_changes"](spark, SMOKE))


def test_miner_takes_all_files_of_touched_commits(spark):
    from changelens.plans.jobs import mine_bug_fix_changes

    commits = spark.createDataFrame([(h, "fix a bug", "main") for h in "abc"], "hash string, message string, branch string")
    files = spark.createDataFrame([("a", "x.py"), ("a", "y.c"), ("a", "y.c"), ("b", "z.c"), ("c", None), ("c", "q.py"), (None, "n.py")], "hash string, path string")
    got = mine_bug_fix_changes(commits, files).select("hash", "path").collect()
    assert sorted(map(str, got)) == sorted(map(str, files.filter("hash IN ('a', 'c')").collect()))
