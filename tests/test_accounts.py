"""Paper accounts whose trades are alike in day, order and line number."""

import datetime

import oracle
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.plans import account

SCHEMA = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()), ("l_returnflag", pa.string()), ("l_shipdate", pa.timestamp("us"))])
DAY = datetime.datetime(1996, 5, 1)


def tables(folder, files):
    """orders of two customers, parts, and lineitem in files of (orderkey, partkey, linenumber, quantity, price, flag)."""
    folder.mkdir()
    pq.write_table(pa.table({"o_orderkey": pa.array([1, 2, 3], pa.int64()), "o_custkey": pa.array([10, 10, 20], pa.int64())}), folder / "orders.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array(range(100), pa.int64()), "p_retailprice": [900.0 + i for i in range(100)]}), folder / "part.parquet")
    (folder / "lineitem.parquet").mkdir()
    for name, rows in files.items():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*[(*r, DAY) for r in rows], strict=True), SCHEMA, strict=True)]
        pq.write_table(pa.Table.from_arrays(columns, schema=SCHEMA), folder / "lineitem.parquet" / name)
    return str(folder)


#: A sale before the purchase that it ties with sells nothing; after it, it sells.
SALE_FIRST = [(1, 5, 1, 4.0, 400.0, "R"), (1, 105, 1, 10.0, 900.0, "N"), (2, 7, 3, 2.0, 50.0, "N")]
BUY_FIRST = [(3, 6, 2, 10.0, 900.0, "A"), (3, 206, 2, 4.0, 400.0, "R"), (3, 6, 2, 20.0, 10.0, "R"), (3, 306, 2, 5.0, 5.0, "N")]


def test_ties_go_by_their_place_in_the_table(spark, tmp_path, monkeypatch):
    def one_thread(path, connect=oracle.connect):
        con = connect(path)
        con.execute("set threads=1")
        return con

    monkeypatch.setattr(oracle, "connect", one_thread)
    monkeypatch.setattr(oracle, "TABLES", ["orders", "part", "lineitem"])
    for name, files in {"one": {"a.parquet": SALE_FIRST + BUY_FIRST}, "two": {"b.parquet": SALE_FIRST[1:] + BUY_FIRST[2:], "a.parquet": SALE_FIRST[:1] + BUY_FIRST[:2] * 3}}.items():
        sf = tables(tmp_path / name, files)
        columns, mine, theirs, n = oracle.differences(spark, account.paper_account, account.SQL["paper_account"], sf)
        assert not columns and not mine and not theirs and n == 2, (name, mine, theirs)


def test_a_sale_before_its_purchase_sells_nothing(spark, tmp_path):
    rows = account.paper_account(spark, tables(tmp_path / "one", {"a.parquet": SALE_FIRST[:2]})).collect()
    assert [(r.o_custkey, r.cash, r.market_value, r.n_positions) for r in rows] == [(10, account.CASH - 900.0, 9050.0, 1)]
