"""What a query's plan did, by its metrics."""


def nodes_of(df):
    """(name, rows put out or None) of each operator of a plan that ran, the last first."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop(0)
        name, metrics = p.getClass().getSimpleName(), p.metrics()
        out.append((name, metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else None))
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def most_rows(df) -> int:
    return max(n or 0 for _, n in nodes_of(df))
