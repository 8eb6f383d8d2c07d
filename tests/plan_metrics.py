"""Rows that the shuffles of a query wrote, from the metrics of its plan."""


def _nodes(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def shuffled_rows(df) -> int:
    """Runs ``df``; a reused shuffle counts once."""
    df.collect()
    written = {}
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            metric = node.metrics().apply("shuffleRecordsWritten")
            written[metric.id()] = metric.value()
    return sum(written.values())
