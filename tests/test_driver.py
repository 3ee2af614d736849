"""What grows with the input is never gathered by the driver to be broadcast."""

import pytest
from conftest import DATA
from threadloom import queries
from threadloom.operators.graph import connected_components

#: Broadcasts of so many rows are left to the planner: the five threads that are shown, and one row for each of five files.
FEW = 5

NAMES = [
    "thread_components_each_list",
    "thread_components_by_list",
    "classification_summary",
    "thread_labels",
    "sender_domain_threads",
    "lookup_counts",
    "accepted_status",
    "version_links",
    "filter_stats",
    "manual_sample",
    "matching_threads_of_many_files",
    "matching_threads_rows",
    "first_email_per_thread",
    "inspect_first_n_threads",
    "last_patch",
    "status_histogram",
    "thread_components_phantom",
    "thread_prompt",
    "thread_components",
]


def broadcast_rows(spark, run) -> list[int]:
    """Of each broadcast that ``run`` makes, the rows."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def executions() -> list[int]:
        bus.waitUntilEmpty()
        there = store.executionsList()
        return [there.apply(i).executionId() for i in range(there.size())]

    before = max(executions(), default=-1)
    run()
    found = []
    for at in (i for i in executions() if i > before):
        nodes, metrics = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                ids = [m.accumulatorId() for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"]
                found += [int(metrics.apply(k).replace(",", "")) for k in ids if metrics.contains(k)]
    return found


def test_broadcasts_are_counted(spark):
    assert broadcast_rows(spark, lambda: spark.range(100).join(spark.range(7).hint("broadcast"), "id").collect()) == [7]


def test_rounds_of_components_broadcast_nothing(spark):
    edges = spark.range(400).selectExpr("id AS a", "id + 1 - id % 4 AS b")
    assert broadcast_rows(spark, lambda: connected_components(edges, few=0).collect()) == []


@pytest.mark.parametrize("name", NAMES)
def test_nothing_that_grows_is_broadcast(spark, name):
    found = broadcast_rows(spark, lambda: queries.QUERIES[name](spark, str(DATA)).write.format("noop").mode("overwrite").save())
    assert max(found, default=0) <= FEW
