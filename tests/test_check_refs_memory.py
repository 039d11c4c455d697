from opinionlake.operators import planning


def test_reference_checks_broadcast_no_lists(spark):
    actions = spark.createDataFrame([(1, "a", "p", ["e1"]), (1, "b", "p", ["e2"]), (2, "c", "q", ["e1"])], "plan_id int, key string, problem_key string, evidence_ids array<string>")
    problems = spark.createDataFrame([(1, "p", ["e1", "e2"])], "plan_id int, problem_key string, problem_refs array<string>")
    evidence = spark.createDataFrame([(1, ["e1"]), (2, ["e1"])], "plan_id int, evidence array<string>")
    checked = planning.check_refs(actions, problems, evidence)
    assert {r["key"]: r["refs_ok"] for r in checked.collect()} == {"a": True, "b": False, "c": False}
    assert "Broadcast" not in checked._jdf.queryExecution().executedPlan().toString()
