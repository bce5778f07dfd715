"""Helpers of several test modules."""


def final_plan(df):
    """The executed plan without the initial versions that adaptive execution prints too."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        column = len(line) - len(line.lstrip(" :"))
        if skip is not None and column > skip:
            continue
        skip = column if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)
