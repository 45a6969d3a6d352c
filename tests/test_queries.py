"""Every query of the engine against its SQL; the import without a session; the entry."""

import subprocess
import sys

import pytest
from conftest import ROOT, same

import __spark_entry__ as entry
from proofgrid.plans import queries as plans


#: The smallest tables have few suppliers and users.
FEW = {"peer_superlative", "peer_claims", "peer_sweep", "audit_lookup", "delivery_fanout", "conflict_lookup"}


@pytest.mark.parametrize("name", list(plans.SQL))
def test_against_sql(spark, sf_dir, name):
    same(plans.QUERIES[name](spark, sf_dir), plans.SQL[name], sf_dir, least=0 if name in FEW else 1)


def test_entry(spark):
    assert {r.status for r in entry.entry(spark).collect()} >= {"VERIFIED", "WRONG_MATH"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True, timeout=120)


def test_gold_match_is_one_to_one(spark, sf_dir):
    rows = plans.QUERIES["gold_match"](spark, sf_dir).collect()
    pred, gold = [(r.doc_id, r.pred) for r in rows if r.pred is not None], [(r.doc_id, r.gold) for r in rows if r.gold is not None]
    assert len(set(pred)) == len(pred) and len(set(gold)) == len(gold)
    both = [r for r in rows if r.pred is not None and r.gold is not None]
    read = [r for r in both if r.pred % 2 == 0]  # the others are made up of items, of which some fill in for a claim that was lost
    assert sum(r.pred == 2 * r.gold for r in read) > 0.9 * len(read) > 0 and len(both) > len(read)


def test_verify_has_no_shuffle_and_no_python(spark, sf_dir):
    df = spark.createDataFrame([("d", "sum", [(1.0, "grounded", None)], 1.0)], "doc_id string, operation string, operands array<struct<value: double, source: string, category: string>>, stated_value double")
    plan = plans.C.verify(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["analyst_gate", "analyst_sweep", "answer_check"])
def test_gates_make_the_ledger_once(spark, sf_dir, name):
    """Gates read the records from the ledger that was written, not again from items (F18, F20, F21)."""
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_returnflag") == 0 if name != "answer_check" else "liabilities_complete" not in plan  # the answers of the last are made of items, without claims


@pytest.mark.parametrize("name", ["variant_facts", "segment_scan"])
def test_company_files_are_read_once(spark, sf_dir, name):
    """One pass over items, and no join of facts with themselves (F15, F13)."""
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_only_form_4_filings_are_parsed(spark, sf_dir):
    """Documents of other filings are not parsed, and items are shuffled before they are text (F22)."""
    plan = plans.QUERIES["ownership_nested"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "collect_list(concat" not in plan


def test_company_files_are_made_in_one_aggregation(spark, sf_dir):
    """Facts are aggregated once, as texts in their order, in all shuffle partitions (F26)."""
    plan = plans.QUERIES["guidance_scan"](spark, sf_dir)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Aggregate [") == 1 and "REPARTITION_BY_NUM" in plan.executedPlan().toString()


def test_facts_are_made_and_chosen_in_one_pass(spark, sf_dir):
    """One scan of orders, and one choice for all forms (F27)."""
    plan = plans.QUERIES["fact_selection"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
