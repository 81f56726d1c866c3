"""SQL of the domain views, as common table expressions for the queries' SQL."""

from __future__ import annotations

VIEWS = {
    "stocks": "SELECT o_orderpriority AS ticker, o_orderdate::DATE AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2",
    "cal": "SELECT session, row_number() OVER (ORDER BY session) AS ordinal FROM (SELECT DISTINCT o_orderdate::DATE AS session FROM orders)",
    "quotes": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand AS ticker, CASE WHEN l_returnflag = 'A' THEN 'call' ELSE 'put' END AS side, p_retailprice AS strike, p_retailprice * (l_tax * 5 + 0.8::DOUBLE + l_linenumber * 0.003::DOUBLE) AS spot, p_retailprice * l_discount / 5 AS bid, p_retailprice * l_discount / 5 * (l_tax + 1) AS ask, l_quantity AS oi, l_shipdate::DATE AS expiry, date_diff('day', DATE '1996-01-01', l_shipdate::DATE) AS dte FROM lineitem JOIN part ON l_partkey = p_partkey",
    "contracts": "SELECT c_custkey AS contract, c_mktsegment AS ticker, CASE WHEN c_acctbal < 0 THEN 'nonstandard_terms' END AS reason FROM customer",
    "ticks": "SELECT event_id AS row_id, user_id AS contract, event_type AS kind, ts, floor(value * 100 + 0.5::DOUBLE)::BIGINT AS cents FROM events",
    "hours": "SELECT contract, date_trunc('hour', ts)::TIMESTAMP AS start, arg_min(cents, row_id) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, row_id) AS close, sum(cents)::BIGINT AS volume, count(*) AS transactions, min(row_id) AS first_row FROM ticks GROUP BY 1, 2",
    "days": "SELECT contract, date_trunc('day', ts)::TIMESTAMP AS start, arg_min(cents, row_id) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, row_id) AS close, sum(cents)::BIGINT AS volume, count(*) AS transactions, min(row_id) AS first_row FROM ticks WHERE kind <> 'error' GROUP BY 1, 2",
    "sessions": "SELECT session, session::TIMESTAMP + INTERVAL '570 minutes' AS open_at, session::TIMESTAMP + INTERVAL '16 hours' AS close_at FROM (SELECT DISTINCT ts::DATE AS session FROM events) WHERE isodow(session) < 6",
    "issuances": "SELECT o_orderkey AS contract, o_orderpriority AS ticker, o_custkey AS owner, o_orderdate AS issued_at, CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'challenger' END AS model, (o_orderkey % 1000) / 1000.0::DOUBLE AS probability, floor(o_totalprice * 100 + 0.5::DOUBLE)::BIGINT AS cents FROM orders",
    "revisions": "SELECT l_orderkey AS contract, l_shipdate AS checked_at, CASE WHEN l_linestatus = 'F' THEN 'valid' ELSE 'pending' END AS status, concat_ws('-', l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR) AS key, l_returnflag = 'R' AS itm FROM lineitem",
    "dists": "SELECT vec_id AS id, list_sort(list_transform(embedding, lambda x: floor(exp(x::DOUBLE) * 1000000 + 0.5::DOUBLE) / 10000.0::DOUBLE)) AS prices FROM embeddings",
}
_NEEDS = {"hours": ["ticks"], "days": ["ticks"]}


def sql(views: str, body: str) -> str:
    """``body`` behind the named views (and those that they need)."""
    names: list[str] = []
    for name in views.split():
        for x in [*_NEEDS.get(name, []), name]:
            if x not in names:
                names.append(x)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}" if head else text
    return f"WITH {head}\n{text}" if head else text
