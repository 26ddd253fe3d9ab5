import datetime as dt
import json

from conftest import dicts
from tallywick.operators.market import latest_listings, market_table, pair_choices, price_display
from tallywick.plans.market import run_market
from tallywick.sources import documents as d
from tallywick.sources.tables import printed_average_table, with_titles

PAIRS = {
    "error": [],
    "result": {
        "XXBTZUSD": {"altname": "XBTUSD", "base": "XXBT", "fees": [[0, 0.26]]},
        "USDTZUSD": {"altname": "USDTUSD", "base": "USDT"},
        "USDCUSD": {"altname": "USDCUSD", "base": "USDC"},
        "XETHXXBT": {"altname": "ETHXBT", "base": "XETH"},
        "SOLUSD": {"altname": "SOLUSD", "base": "SOL"},
    },
}
OHLC = {
    "error": [],
    "result": {
        "XXBTZUSD": [
            [1656547200, "19000.5", "20000.0", "18000.1", "19500.0", "19400.2", "12.5", 100],
            [1657152000, "n/a", "21000.0", "19000.0", "20500.0", "20400.0", "10.0", 90],
        ],
        "last": 1656547200,
    },
}


def usd(price, cap, **more):
    base = {
        "price": price, "volume_24h": 1234.5678, "percent_change_1h": 1.23456, "percent_change_24h": -2.5,
        "percent_change_7d": 3.0, "percent_change_30d": 4.0, "percent_change_60d": 5.0, "percent_change_90d": 6.0,
        "market_cap": cap, "market_cap_dominance": 40.12349, "last_updated": "2022-09-02T12:34:56.000Z",
    }
    return {"USD": {**base, **more}}


LISTINGS = {
    "status": {"error_code": 0},
    "data": [
        {"id": 1, "name": "Bitcoin", "symbol": "BTC", "slug": "bitcoin", "date_added": "2013-04-28T00:00:00.000Z",
         "max_supply": 21000000, "circulating_supply": 19e6, "total_supply": 19e6, "quote": usd(19999.123456, 100.129)},
        {"id": 2, "name": "Dust", "symbol": "DST", "slug": "dust", "date_added": "2020-01-01T10:00:00.000Z",
         "max_supply": None, "circulating_supply": 1.0, "total_supply": 2.0, "quote": usd(0.00012, 300.0, last_updated="?")},
        {"id": 3, "name": "Nameless", "slug": "nameless", "date_added": "soon", "quote": usd(12345678.9, 200.0)},
    ],
}


def landed(spark, tmp_path, *texts):
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(json.dumps(text, indent=2))
    return d.read_documents(spark, str(tmp_path))


def test_one_row_per_file(spark, tmp_path):
    assert landed(spark, tmp_path, PAIRS, OHLC).count() == 2


def test_pairs(spark, tmp_path):
    catalog = d.pair_catalog(landed(spark, tmp_path, PAIRS))
    assert [(r["asset_tick"], r["altname"], r["base"]) for r in dicts(catalog, "asset_tick")] == [
        ("SOLUSD", "SOLUSD", "SOL"), ("USDCUSD", "USDCUSD", "USDC"), ("USDTZUSD", "USDTUSD", "USDT"),
        ("XXBTZUSD", "XBTUSD", "XXBT"),
    ]
    choices = {r["asset_tick"]: (r["display_name"], r["chosen_key"]) for r in dicts(pair_choices(catalog))}
    assert choices == {
        "SOLUSD": ("SOL USD", "SOLUSD"), "USDCUSD": (" USDCUSD", "USDCUSD"), "XXBTZUSD": ("XXBTZ USD", "XXBTZUSD"),
    }


def test_bars(spark, tmp_path):
    first, second = dicts(d.ohlc_bars(landed(spark, tmp_path, OHLC)), "ts")
    assert first == {
        "asset": "XXBTZUSD", "ts": dt.datetime(2022, 6, 30), "date_est": dt.datetime(2022, 6, 29, 19), "open": 19000.5,
        "high": 20000.0, "low": 18000.1, "close": 19500.0, "vwap": 19400.2, "volume": 12.5, "trades": 100,
    }
    assert second["open"] is None and second["close"] == 20500.0


def test_broken_and_empty_documents_give_no_rows(spark, tmp_path):
    docs = landed(spark, tmp_path, {"error": ["busy"]}, {"error": [], "result": {"A": [], "last": 1}})
    assert d.ohlc_bars(docs).count() == 0
    assert d.pair_catalog(docs).count() == 0
    assert d.listings(docs).count() == 0


def test_listings(spark, tmp_path):
    btc, dust, nameless = dicts(d.listings(landed(spark, tmp_path, LISTINGS)), "id")
    assert btc["price"] == 19999.1235 and btc["date_added"] == dt.date(2013, 4, 28)
    assert (btc["percent_change_1h"], btc["percent_change_24h"], btc["market_cap_dominance"]) == (0.0123, -0.025, 0.4012)
    assert btc["last_updated"] == dt.datetime(2022, 9, 2, 12, 34, 56) and btc["max_supply"] == 21e6
    assert dust["max_supply"] is None and dust["last_updated"] is None and dust["price"] == 0.0001
    assert nameless["ticker"] is None and nameless["date_added"] is None


def test_market_table(spark, tmp_path):
    landed(spark, tmp_path, LISTINGS)
    rows = run_market(spark, str(tmp_path)).collect()
    assert [r.coin for r in rows] == ["Dust", "Nameless", "Bitcoin"]  # by market value
    assert [r.price_text for r in rows] == ["$0.0001", "$12345678.9", "$19999.1235"]
    assert rows[2].volume_24h == 1234.57 and rows[2].market_cap == 100.13
    assert rows[2].volume_change_24h == rows[2].pct_change_24h == -0.025
    listed = d.listings(d.read_documents(spark, str(tmp_path)))
    assert market_table(listed, 2).count() == 2 and latest_listings(listed, 1).first().coin == "Dust"
    titles = with_titles(market_table(listed), "market_table").columns
    assert titles == [
        "Coin", "Ticker", "Price", "Volume 24H", "Volume Change 24H", "% Change 1H", "% Change 24H", "% Change 7D",
        "% Change 30D", "Market Cap", "Market Cap Dominance",
    ]
    assert "price_text" in price_display(market_table(listed)).columns


def test_printed_average_table(spark):
    table = spark.createDataFrame(
        [("XXBTZUSD", "BTC", 1.0, 150, 2.0, 3.0, 4.0, "150 Week Average"), ("B", "B", 1.0, 9, None, None, 4.0, "9 Week Average")],
        "asset_tick string, asset string, current_price double, week_count int, avg_50 double, avg_100 double, "
        "avg_overall double, overall_title string",
    )
    printed = printed_average_table(table, "XXBTZUSD")
    assert printed.columns == ["Asset", "Current Price", "50 Week Average", "100 Week Average", "150 Week Average"]
    assert [tuple(row) for row in printed.collect()] == [("BTC", 1.0, 2.0, 3.0, 4.0)]
    assert printed_average_table(table, "B").columns == ["Asset", "Current Price", "9 Week Average"]
    assert printed_average_table(table, "C").collect() == []


def test_documents_one_per_line(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(text) for text in (PAIRS, {"result": {"E": {"altname": "EUSD", "base": "E"}}})))
    catalog = d.pair_catalog(d.read_documents(spark, str(tmp_path), one_per_line=True))
    assert {row.asset_tick for row in catalog.collect()} == {"SOLUSD", "USDCUSD", "USDTZUSD", "XXBTZUSD", "E"}
