"""Market messages and exchange metadata, as JSON text, to typed rows. What fails a rule is kept with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stream suffix, payload event name, row type, and (name, payload key, kind) of each typed field.
TYPES = {
    "bookTicker": ("bookTicker", "book_ticker", [("update_id", "u", "long"), ("bid_price", "b", "decimal"), ("bid_qty", "B", "decimal"), ("ask_price", "a", "decimal"), ("ask_qty", "A", "decimal"), ("transaction_time_ms", "T", "long")]),
    "aggTrade": ("aggTrade", "aggregate_trades", [("aggregate_trade_id", "a", "long"), ("price", "p", "decimal"), ("quantity", "q", "decimal"), ("first_trade_id", "f", "long"), ("last_trade_id", "l", "long"), ("trade_time_ms", "T", "long"), ("buyer_is_maker", "m", "boolean")]),
    "markPrice": ("markPriceUpdate", "mark_price", [("mark_price", "p", "decimal"), ("index_price", "i", "decimal"), ("estimated_settle_price", "P", "decimal"), ("funding_rate", "r", "decimal"), ("next_funding_time_ms", "T", "long")]),
    "kline_1m": ("kline", "kline_1m", [("open_time_ms", "k.t", "long"), ("close_time_ms", "k.T", "long"), ("open", "k.o", "decimal"), ("high", "k.h", "decimal"), ("low", "k.l", "decimal"), ("close", "k.c", "decimal"), ("base_volume", "k.v", "decimal"), ("quote_volume", "k.q", "decimal"), ("trade_count", "k.n", "long"), ("taker_buy_base_volume", "k.V", "decimal"), ("taker_buy_quote_volume", "k.Q", "decimal"), ("is_closed", "k.x", "boolean")]),
}


_JSON = {"long": "BIGINT", "decimal": "STRING", "boolean": "BOOLEAN"}


def _number(text: Column) -> Column:
    d = text.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def parse(raw: DataFrame, value: str = "value", passed: tuple[str, ...] = ()) -> DataFrame:
    """All messages as rows: event_id, kind, symbol, event_time_ms, fields (a struct for each kind, null for others),
    decimal fields as text beside their number, reject_reason; columns named in ``passed`` are kept. Acknowledgements
    ({"result", "id"}) are no events and are left out.

    The text is parsed once; each step below reads the columns of the one before: fields as they are, those of the
    wanted JSON type (a boolean is no integer, a number no decimal text), numbers, and last rows and reasons."""
    v, get = F.col("__v"), F.try_variant_get
    df = raw.select(*passed, F.col(value).alias("__text"), F.try_parse_json(value).alias("__v"))
    used = sorted({(key, how) for _, _, fields in TYPES.values() for _, key, how in fields} | {("E", "long")})
    at = {k: f"__f{i}" for i, k in enumerate(sorted({key for key, _ in used}))}
    typed = {u: f"__t{i}" for i, u in enumerate(used)}
    number = {u: f"__n{i}" for i, u in enumerate(used) if u[1] == "decimal"}
    stream = get(v, "$.stream", "string")
    df = df.select(
        *passed, "__text", v.isNotNull().alias("__ok"), stream.alias("stream"), F.upper(F.split_part(stream, F.lit("@"), F.lit(1))).alias("symbol"), F.regexp_replace(F.split_part(stream, F.lit("@"), F.lit(2)), "^markPrice@1s$", "markPrice").alias("suffix"),
        get(v, "$.data.s", "string").alias("__named"), get(v, "$.data.e", "string").alias("__event"), get(v, "$.data.k.i", "string").alias("__interval"), F.schema_of_variant(get(v, "$.data", "variant")).alias("__data"),
        (get(v, "$.id", "variant").isNotNull() & F.col("__text").rlike(r'"result"\s*:')).alias("__ack"), *[get(v, f"$.data.{k}", "variant").alias(c) for k, c in at.items()],
    ).where("NOT (__ack AND stream IS NULL)")
    text = {"long": "long", "decimal": "string", "boolean": "boolean"}
    df = df.withColumns({c: F.when(F.schema_of_variant(F.col(at[k])) == _JSON[how], get(F.col(at[k]), "$", text[how])) for (k, how), c in typed.items()})
    df = df.withColumns({c: _number(F.col(typed[u])) for u, c in number.items()})
    structs, faults, wrong = [], [], F.lit(False)
    for suffix, (event, kind, fields) in TYPES.items():
        here, parts = F.col("suffix") == suffix, []
        for name, key, how in fields:
            x = F.col(typed[key, how])
            parts += [F.col(number[key, how]).alias(name), x.alias(f"{name}_str")] if how == "decimal" else [x.alias(name)]
            faults.append(F.when(here & (F.col(number[key, how]) if how == "decimal" else x).isNull(), F.lit(f"field {key}")))
        structs.append(F.when(here, F.struct(*parts)).alias(kind))
        wrong = wrong | (here & (F.coalesce(F.col("__event"), F.lit("")) != event))
    interval = (F.col("suffix") == "kline_1m") & (F.coalesce(F.col("__interval"), F.lit("")) != "1m")
    reason = (
        F.when(~F.col("__ok") | F.col("stream").isNull() | ~F.coalesce(F.col("__data").startswith("OBJECT"), F.lit(False)), "not a message")
        .when(F.col("__event") == "serverShutdown", "shutdown").when((F.col("symbol") == "") | (F.coalesce(F.col("__named"), F.lit("")) != F.col("symbol")), "symbol")
        .when(~F.col("suffix").isin(*TYPES), "unsupported stream").when(wrong, "event type").when(interval, "interval").when(F.col(typed["E", "long"]).isNull(), "field E").otherwise(F.coalesce(*faults))
    )
    kinds = F.create_map(*[F.lit(x) for s, (_, k, _) in TYPES.items() for x in (s, k)])
    ident = F.sha2(F.concat_ws("\x1f", "stream", F.get_json_object("__text", "$.data")), 256)  # of the payload's text as received
    return df.select(*passed, ident.alias("event_id"), F.element_at(kinds, F.col("suffix")).alias("kind"), "symbol", F.col(typed["E", "long"]).alias("event_time_ms"), *structs, reason.alias("reject_reason"))


def of_kind(parsed: DataFrame, kind: str, passed: tuple[str, ...] = ()) -> DataFrame:
    """Accepted rows of one kind with its fields as columns."""
    return parsed.where((F.col("kind") == kind) & F.col("reject_reason").isNull()).select(*passed, "event_id", "symbol", "event_time_ms", f"{kind}.*")


def message_counts(parsed: DataFrame) -> DataFrame:
    """Messages and rejects by kind and symbol."""
    return parsed.groupBy("kind", "symbol").agg(F.count("*").alias("messages"), F.count("reject_reason").alias("rejected"))


def invalid_values(rows: DataFrame, kind: str) -> Column:
    """Whether a row's market values are impossible."""
    c = F.col
    rules = {
        "book_ticker": (c("bid_price") <= 0) | (c("ask_price") <= 0) | (c("bid_qty") < 0) | (c("ask_qty") < 0) | (c("bid_price") > c("ask_price")),
        "aggregate_trades": (c("price") <= 0) | (c("quantity") <= 0) | (c("first_trade_id") > c("last_trade_id")),
        "mark_price": (c("mark_price") <= 0) | (c("index_price") <= 0),
        "kline_1m": (F.least("open", "high", "low", "close") <= 0) | (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close")) | (c("base_volume") < 0) | (c("quote_volume") < 0),
    }
    return F.coalesce(rules[kind], F.lit(True))


def stream_audit(rows: DataFrame, kind: str, received: str, clock_offset_ms: int = 0) -> DataFrame:
    """One row: rows, first and last event time, surplus ids, impossible values, latency quantiles in milliseconds, and
    the p95 and greatest seconds between neighbours of a symbol by arrival (nanoseconds)."""
    from ..operators.aggregates import exact_quantiles
    from ..operators.windows import previous

    basic = rows.agg(F.count("*").alias("n_rows"), F.min("event_time_ms").alias("first_ms"), F.max("event_time_ms").alias("last_ms"), (F.count("*") - F.count_distinct("event_id")).alias("duplicates"), F.count_if(invalid_values(rows, kind)).alias("invalid"))
    lag_ms = F.col(received) / 1e6 + clock_offset_ms - F.col("event_time_ms")
    latency = exact_quantiles(rows.select(lag_ms.alias("x")), [], "x", {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99})
    near = previous(rows.select("symbol", received, "event_id"), ["symbol"], [received, "event_id"], [received], 3_600_000_000_000)
    gap = near.select(((F.col(received) - F.col(f"prev.{received}")) / 1e9).alias("x")).where("x IS NOT NULL")
    stale = exact_quantiles(gap, [], "x", {"staleness_p95": 0.95, "staleness_max": 1.0})
    return basic.join(F.broadcast(latency), how="left").join(F.broadcast(stale), how="left")  # one row each


def instruments(raw: DataFrame, value: str = "value") -> DataFrame:
    """Exchange information documents to one row a symbol: status, assets, precision, and the filters by their type;
    the least notional is that of MIN_NOTIONAL, else of NOTIONAL."""
    filters = "array<struct<filterType:string,tickSize:string,minPrice:string,maxPrice:string,stepSize:string,minQty:string,maxQty:string,notional:string,minNotional:string>>"
    symbol = f"struct<symbol:string,pair:string,contractType:string,status:string,onboardDate:bigint,baseAsset:string,quoteAsset:string,pricePrecision:int,quantityPrecision:int,filters:{filters}>"
    doc = raw.select(F.from_json(value, f"serverTime bigint, symbols array<{symbol}>").alias("d")).select("d.serverTime", F.explode("d.symbols").alias("s"))
    of = lambda kind, field: F.get(F.filter("s.filters", lambda x: x["filterType"] == kind), F.lit(0))[field]
    number = lambda c: c.try_cast("decimal(38,18)")
    return doc.select(
        F.col("serverTime").alias("valid_from_ms"), "s.symbol", F.col("s.contractType").alias("contract_type"), "s.status", F.col("s.onboardDate").alias("onboard_ms"), F.col("s.baseAsset").alias("base_asset"), F.col("s.quoteAsset").alias("quote_asset"),
        number(of("PRICE_FILTER", "tickSize")).alias("tick_size"), number(of("LOT_SIZE", "stepSize")).alias("step_size"), number(of("LOT_SIZE", "minQty")).alias("min_qty"),
        number(F.coalesce(of("MIN_NOTIONAL", "notional"), of("NOTIONAL", "minNotional"), of("NOTIONAL", "notional"))).alias("min_notional"),
    )
