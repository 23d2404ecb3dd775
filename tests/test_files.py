"""Readers and writers of files."""

import json
import os

from tradeframe.sources import files


def test_files(spark, tmp_path):
    trades = tmp_path / "trades"
    trades.mkdir()
    head = "mint,block_timestamp,succeeded,swapper,swap_from_amount,swap_from_mint,swap_to_amount,swap_to_mint,__row_index\n"
    for i in range(2):
        (trades / f"t{i}.csv").write_text(head + f"m,2024-01-01 00:00:0{i},true,u,1.5,SOL,3,m,{i}\n")
    (trades / "._t0.csv").write_text("junk")
    rows = files.read_trades(spark, str(trades)).orderBy("row_index").collect()
    assert [(r.row_index, r.swap_from_amount, r.block_timestamp.second) for r in rows] == [(0, 1.5, 0), (1, 1.5, 1)]
    bars = tmp_path / "bars"
    bars.mkdir()
    (bars / "2024-03-05.csv").write_text("time,open,high,low,close,vwap,volume,transactions\n" + "09:30:00,1,2,0.5,1.5,1.2,100,7\n" * 2)
    got = files.read_daily_bars(spark, str(bars)).collect()
    assert len(got) == 1 and str(got[0].datetime) == "2024-03-05 09:30:00" and got[0].date_str == "2024-03-05"
    page = tmp_path / "pages"
    page.mkdir()
    (page / "p.json").write_text(json.dumps({"result": {"rows": [{"a": 1}, {"a": 2}]}}, indent=1))
    assert sorted(r.a for r in files.read_paged_json(spark, str(page)).collect()) == [1, 2]
    lines = tmp_path / "lines"
    lines.mkdir()
    some = [{"conditionId": c, "asset": "1", "side": "BUY", "price": p, "size": "2", "timestamp": "60", "proxyWallet": "w"} for c, p in (("0xAB", "0.5"), ("0xab", "none"), ("0xCD", "1"))]
    (lines / "t.jsonl").write_text("\n".join(map(json.dumps, some)))
    assert sorted((r.price is None, r.price) for r in files.read_market_trades(spark, str(lines), "0xAb").collect()) == [(False, 0.5), (True, None)]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "mint string, x int")
    for fmt in ("csv", "json", "parquet"):
        files.write_output(df, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt))
        assert back.count() == 2 and set(back.columns) == {"mint", "x"}
    files.write_bars(df, str(tmp_path / "by"), "mint")
    assert {x for x in os.listdir(tmp_path / "by") if "=" in x} == {"mint=a", "mint=b"}
