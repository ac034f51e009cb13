"""What one task holds doesn't grow with the tables, and a document's rows are shuffled no oftener than they must be."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronolake.operators import companyfacts, stages
from chronolake.plans import documents as plans
from chronolake.sources import documents

FOLDER = "/root/testdata/sf0.001"


def shuffles(df):
    """Hash exchanges of the plan, and their numbers of partitions."""
    said = io.StringIO()
    with redirect_stdout(said):
        df.explain()
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\), ", said.getvalue())]


def test_parts_follow_the_rows(spark):
    assert stages.parts_of(spark, 1000) is None
    assert stages.parts_of(spark, 216_000_000) == 540 and stages.parts_of(spark, 36_000_000) == 90


@pytest.mark.parametrize("name, most", [("facts_storage_v2", 2), ("facts_storage_withheld", 2)])
def test_documents_meet_once(spark, name, most):
    assert len(shuffles(entry.queries()[name](spark, FOLDER))) <= most


def test_orders_and_lines_meet_in_parts(spark, monkeypatch):
    """Both sides of the join lie in as many parts as the rows need, not in the session's partitions, and are not sorted."""
    whole = entry.queries()["facts_storage_withheld"](spark, FOLDER)
    monkeypatch.setattr(plans, "_parts", lambda spark, d: 7)
    found = entry.queries()["facts_storage_withheld"](spark, FOLDER)
    assert shuffles(found).count(7) == 4 and set(shuffles(found)) == {7}
    said = io.StringIO()
    with redirect_stdout(said):
        found.explain()
    assert "ShuffledHashJoin" in said.getvalue() and "SortMergeJoin" not in said.getvalue()
    assert found.exceptAll(whole).isEmpty() and found.count() == whole.count()


@pytest.mark.parametrize("policy", ["sec-companyfacts-v3", "sec-companyfacts-v4"])
def test_exact_policies_shuffle_after_unions_only(spark, policy):
    rows = companyfacts.stored_facts(documents.company_facts(plans.payloads(spark, FOLDER)), companyfacts.POLICIES[policy], parts=7)
    assert shuffles(rows).count(7) >= 2
    assert rows.count() == companyfacts.stored_facts(documents.company_facts(plans.payloads(spark, FOLDER)), companyfacts.POLICIES[policy]).count()


@pytest.mark.parametrize("policy", ["sec-companyfacts-v3", "sec-companyfacts-v4"])
def test_exact_policies_keep_to_their_parts(spark, policy):
    """No window or group after the documents falls back on the session's partitions, and periods have one order for all windows."""
    facts = documents.company_facts(plans.payloads(spark, FOLDER))
    issuer = F.when(F.col("cik") % 2 == 0, "refiner").otherwise("assessed")
    rows = companyfacts.stored_facts(facts, companyfacts.POLICIES[policy], issuer, parts=7)
    assert set(shuffles(rows)) == {7} and len(shuffles(rows)) <= 4
    said = io.StringIO()
    with redirect_stdout(said):
        rows.explain()
    assert len(re.findall(r"\bSort \[key", said.getvalue())) <= 5 and "Join" not in said.getvalue()


def test_named_metrics_only(spark):
    facts = documents.company_facts(plans.payloads(spark, FOLDER))
    policy, issuer = companyfacts.POLICIES["sec-companyfacts-v4"], F.when(F.col("cik") % 2 == 0, "refiner").otherwise("assessed")
    some, whole = companyfacts.stored_facts(facts, policy, issuer, 7, ["revenue"]), companyfacts.stored_facts(facts, policy, issuer).where("metric = 'revenue'")
    assert sorted(some.collect()) == sorted(whole.collect()) and some.where(F.exists("locators", lambda x: F.contains(x, F.lit(companyfacts.NET_REVENUE)))).count() > 0


def test_document_is_one_group(spark):
    said = io.StringIO()
    with redirect_stdout(said):
        plans.payloads(spark, FOLDER).explain()
    assert said.getvalue().count("ObjectHashAggregate(") == 2


def test_lines_meet_once(spark):
    """Duplicate and conflicting keys of lines are one aggregate of rows that meet by order, without a distinct count."""
    said = io.StringIO()
    with redirect_stdout(said):
        entry.queries()["relation_report"](spark, FOLDER).explain()
    assert not re.search(r"count\(distinct l_quantity", said.getvalue()) and "partial_count(1), partial_count(distinct" not in said.getvalue()
    assert len(re.findall(r"hashpartitioning\(l_orderkey#\d+L?, l_linenumber", said.getvalue())) == 0
