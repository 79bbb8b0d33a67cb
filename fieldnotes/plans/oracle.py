"""SQL that states what the engine's results have to be, for DuckDB."""

from __future__ import annotations


def rounded(value: str, digits: int = 4) -> str:
    """Correct decimal rounding of the binary value."""
    return f"(CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE) + 0.0)"


def percent(part: str, whole: str, digits: int = 2) -> str:
    return rounded(f"CAST({part} AS DOUBLE) / {whole} * 100", digits)


_NAME = r"(^|[\s_\-])(id|uuid|key|code)$|^id[\s_\-]|identifier"
_EMPTY_SUMMARY = {
    "mean": "DOUBLE", "std": "DOUBLE", "min": "DOUBLE", "max": "DOUBLE", "mode": "VARCHAR",
    "mode_pct": "DOUBLE", "true_pct": "DOUBLE", "first": "TIMESTAMP", "last": "TIMESTAMP",
}


def _codebook_line(position: int, name: str, kind: str, source: str, value: str) -> str:
    """One codebook line of a column whose storage kind is number, time, text or other."""
    summary = {k: f"CAST(NULL AS {t})" for k, t in _EMPTY_SUMMARY.items()}
    facts = f"count(*) AS rows_, count({value}) AS valid_"
    distinct, kind_, discrete, identifier = f"count(DISTINCT {value})", f"'{kind}'", "false", "false"
    if kind == "numeric":
        facts += (
            f", min({value}) AS min_, max({value}) AS max_, fsum({value}) AS sum_, stddev_samp({value}) AS std_"
            f", bool_and({value} = floor({value})) AS whole_"
        )
        discrete = "whole_ AND unique_ <= 25 AND max_ - min_ <= 100"
        identifier = (
            "whole_ AND unique_ = valid_ AND valid_ >= 10 AND "
            f"(max_ - min_ = valid_ - 1 OR regexp_matches('{name}', '{_NAME}', 'i'))"
        )
        summary.update(mean=rounded("sum_ / valid_"), std=rounded("std_"), min=rounded("min_"), max=rounded("max_"))
    elif kind == "datetime":
        facts += f", min({value}) AS min_, max({value}) AS max_"
        summary.update(first="min_", last="max_")
    elif kind == "label":
        top = f"(SELECT struct_pack(v := {value}, c := count(*)) FROM {source} WHERE {value} IS NOT NULL " \
              f"GROUP BY {value} ORDER BY count(*) DESC, {value} LIMIT 1)"
        facts += f", {top} AS top_"
        identifier = "unique_ = valid_ AND valid_ >= 10"
        kind_ = (
            "CASE WHEN (unique_ = valid_ AND valid_ >= 10) OR (unique_ > 20 AND unique_ > 0.8 * valid_) "
            "OR (unique_ > 50 AND unique_ > 0.5 * valid_) THEN 'text' ELSE 'categorical' END"
        )
        summary.update(mode="top_.v", mode_pct=percent("top_.c", "valid_", 1))
    else:
        distinct = "CAST(NULL AS BIGINT)"
    fields = ", ".join(f"{e} AS {k}" for k, e in summary.items())
    return (
        f"SELECT CAST({position} AS INTEGER) AS position, '{name}' AS name, {kind_} AS kind, "
        f"{discrete} AS discrete, {identifier} AS is_identifier, valid_ AS valid, rows_ - valid_ AS missing, "
        f"{percent('rows_ - valid_', 'rows_')} AS missing_pct, unique_ AS \"unique\", {fields} "
        f"FROM (SELECT {facts}, {distinct} AS unique_ FROM {source})"
    )


def codebook(source: str, columns: list[tuple[str, str]]) -> str:
    """``columns`` pairs each name with numeric, datetime, label or unsupported."""
    lines = []
    for position, (name, kind) in enumerate(columns, 1):
        value = f"CAST({name} AS DOUBLE)" if kind == "numeric" else name
        lines.append(_codebook_line(position, name, kind, source, value))
    return " UNION ALL ".join(lines)


def _base(column: str, kind: str, value: str) -> str:
    return (
        f"'{column}' AS \"column\", '{kind}' AS kind, count({value}) AS valid, count(*) - count({value}) AS missing, "
        f"{percent(f'count(*) - count({value})', 'count(*)')} AS missing_pct, count(DISTINCT {value}) AS \"unique\""
    )


def describe_numeric(source: str, column: str, value: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    q = {k: f"quantile_cont(v, {s})" for k, s in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    stats = {
        "mean": "fsum(v) / count(v)", "std": "stddev_samp(v)", "sem": "stddev_samp(v) / sqrt(count(v))",
        "min": "min(v)", "q1": q["q1"], "median": q["median"], "q3": q["q3"], "max": "max(v)",
        "iqr": f"{q['q3']} - {q['q1']}", "range": "max(v) - min(v)", "sum": "fsum(v)",
        "skewness": "coalesce(skewness(v), 0)",
    }
    fields = ", ".join(f"{rounded(e)} AS \"{k}\"" for k, e in stats.items())
    return f"SELECT {_base(column, 'numeric', 'v')}, {fields} FROM (SELECT {v} AS v FROM {source})"


def describe_label(source: str, column: str, value: str, kind: str) -> str:
    top = "FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1"
    return (
        f"WITH t AS (SELECT {value} AS v FROM {source}) SELECT {_base(column, kind, 'v')}, "
        f"(SELECT v {top}) AS mode, (SELECT count(*) {top}) AS mode_count, "
        f"{percent(f'(SELECT count(*) {top})', 'count(v)')} AS mode_pct, "
        f"{rounded('avg(length(v))', 1)} AS mean_length FROM t"
    )


def describe_boolean(source: str, column: str, value: str) -> str:
    return (
        f"SELECT {_base(column, 'boolean', 'v')}, count(*) FILTER (v) AS true_count, "
        f"count(*) FILTER (NOT v) AS false_count, {percent('count(*) FILTER (v)', 'count(v)')} AS true_pct "
        f"FROM (SELECT {value} AS v FROM {source})"
    )


def describe_datetime(source: str, column: str, value: str) -> str:
    return (
        f"SELECT {_base(column, 'datetime', 'v')}, min(v) AS min, max(v) AS max, "
        "make_timestamp(CAST(floor(quantile_cont(CAST(epoch_us(v) AS DOUBLE), 0.5)) AS BIGINT)) AS median, "
        f"{rounded('(epoch_us(max(v)) - epoch_us(min(v))) / 86400e6', 2)} AS span_days "
        f"FROM (SELECT CAST({value} AS TIMESTAMP) AS v FROM {source})"
    )


def histogram(source: str, value: str, bins: int | None = None) -> str:
    """The automatic bin rule, the round edges and the counts as one statement."""
    if bins is None:
        width = "least(greatest(2 * (q3 - q1) * pow(n, -1.0/3), span / sqrt(n) / 2), span / (log2(n) + 1))"
        target = f"least(greatest(ceil(span / {width}), 5), 30)"
    else:
        target = str(bins)
    return f"""
    WITH t AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source}),
    f AS (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, max(v) - min(v) AS span,
                 quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t),
    r AS (SELECT *, span / {target} AS raw FROM f),
    m AS (SELECT *, pow(10, floor(log10(raw))) AS p FROM r),
    s AS (SELECT *, CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 2.5 * p THEN CAST(2.5 AS DOUBLE) * p
                    WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS step FROM m),
    e AS (SELECT *, floor(lo / step) * step AS a, greatest(ceil(hi / step) * step, floor(lo / step) * step + step) AS z FROM s),
    b AS (SELECT unnest(range(CAST(round((z - a) / step) AS BIGINT))) AS k, a, step, n, round((z - a) / step) AS total FROM e),
    x AS (SELECT k, n, total, {rounded('a + k * step', 10)} AS start, {rounded('a + (k + 1) * step', 10)} AS "end" FROM b),
    c AS (SELECT k, n, start, "end", count(v) AS count FROM x LEFT JOIN t
          ON v >= start AND (v < "end" OR (k = total - 1 AND v = "end")) GROUP BY ALL)
    SELECT CAST(k + 1 AS INTEGER) AS position, start, "end", count, {percent('count', 'n')} AS pct FROM c
    """


def timeline(source: str, value: str, unit: str) -> str:
    label = {"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}[unit]
    return f"""
    WITH t AS (SELECT date_trunc('{unit}', {value}) AS p FROM {source} WHERE {value} IS NOT NULL),
    s AS (SELECT unnest(generate_series((SELECT CAST(min(p) AS TIMESTAMP) FROM t), (SELECT CAST(max(p) AS TIMESTAMP) FROM t), INTERVAL 1 {unit})) AS p),
    c AS (SELECT CAST(p AS TIMESTAMP) AS p, count(*) AS c FROM t GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY s.p) AS INTEGER) AS position, strftime(s.p, '{label}') AS label,
           coalesce(c.c, 0) AS count, {percent('coalesce(c.c, 0)', '(SELECT count(*) FROM t)')} AS pct
    FROM s LEFT JOIN c ON s.p = c.p
    """


def categorical(source: str, value: str, top: int) -> str:
    return f"""
    WITH g AS (SELECT {value} AS label, count(*) AS count FROM {source} WHERE {value} IS NOT NULL GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY count DESC, label) AS rn, sum(count) OVER () AS total, count(*) OVER () AS cats FROM g)
    SELECT CAST(rn AS INTEGER) AS position, label, count, {percent('count', 'total')} AS pct, false AS is_other,
           CAST(NULL AS BIGINT) AS categories FROM r WHERE rn <= {top}
    UNION ALL
    SELECT CAST({top + 1} AS INTEGER), 'Other (' || format('{{:,}}', any_value(cats) - {top}) || CASE WHEN any_value(cats) - {top} = 1 THEN ' category)' ELSE ' categories)' END,
           CAST(sum(count) AS BIGINT), {percent('sum(count)', 'any_value(total)')}, true, CAST(any_value(cats) - {top} AS BIGINT)
    FROM r WHERE rn > {top} HAVING count(*) > 0
    """


_AGGREGATES = {
    "mean": "fsum(m) / count(m)", "median": "quantile_cont(m, 0.5)", "sum": "coalesce(fsum(m), 0)",
    "min": "min(m)", "max": "max(m)", "count": "CAST(count(*) AS DOUBLE)",
}


def _pairs(source: str, group: str, metric: str | None) -> str:
    return f"SELECT {group} AS g, CAST({metric or 'NULL'} AS DOUBLE) AS m FROM {source}"


def compare(source: str, group: str, metric: str | None, agg: str, sort: str = "desc", limit: int = 50,
            label: str = "g", label_key: str = "lower(g), g") -> str:
    order = {"desc": "value DESC NULLS LAST, g", "asc": "value ASC NULLS LAST, g", "label": label_key}[sort]
    return f"""
    WITH p AS ({_pairs(source, group, metric)}),
    k AS (SELECT g, count(*) AS rows, count(m) AS n, {_AGGREGATES[agg]} AS value FROM p WHERE g IS NOT NULL
          GROUP BY g ORDER BY rows DESC, g LIMIT {limit})
    SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, {label} AS label,
           {rounded('value')} AS value, n, rows FROM k
    """


def compare_overall(source: str, group: str, metric: str | None, agg: str, sort: str, limit: int, names: tuple) -> str:
    if agg == "count":
        overall = "(SELECT CAST(sum(rows) AS DOUBLE) FROM (SELECT count(*) AS rows FROM p WHERE g IS NOT NULL GROUP BY g ORDER BY rows DESC, g LIMIT %d))" % limit
    else:
        overall = f"(SELECT {_AGGREGATES[agg]} FROM p WHERE m IS NOT NULL)"
    metric_name = f"'{names[1]}'" if names[1] else "CAST(NULL AS VARCHAR)"
    return f"""
    WITH p AS ({_pairs(source, group, metric)})
    SELECT '{names[0]}' AS group_by, {metric_name} AS metric, '{agg}' AS agg, '{sort}' AS sort,
           {rounded(overall)} AS overall, count(DISTINCT g) AS total_groups,
           count(DISTINCT g) > {limit} AS truncated, count(*) - count(g) AS missing_groups FROM p
    """
