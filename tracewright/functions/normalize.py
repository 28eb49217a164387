"""Column helpers that turn raw provider rows into events: asset keys, action classes, primary legs, ids, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provider chain code to price-source chain.
PRICE_CHAINS = {"eth": "ethereum", "bsc": "bsc", "arb": "arbitrum", "op": "optimism", "base": "base", "matic": "polygon", "avax": "avax"}
#: Provider chain code to the names of the block explorer, the node provider and the pool index.
EXPLORER_CHAINS = {"eth": "eth", "bsc": "bsc", "arb": "arbitrum", "op": "optimism", "base": "base", "matic": "polygon", "avax": "avalanche"}
RPC_CHAINS = {"eth": "ethereum", "bsc": "bsc", "arb": "arbitrum", "op": "optimism", "base": "base", "matic": "polygon", "avax": "avalanche"}
NETWORKS = {"eth": "ethereum", "bsc": "bsc", "arb": "arbitrum", "op": "optimism", "base": "base", "matic": "polygon", "avax": "avalanche"}
#: Native coins by (chain, token).
NATIVE = {
    ("eth", "eth"): "coingecko:ethereum",
    ("arb", "eth"): "coingecko:ethereum",
    ("op", "eth"): "coingecko:ethereum",
    ("base", "eth"): "coingecko:ethereum",
    ("bsc", "bnb"): "coingecko:binancecoin",
    ("matic", "matic"): "coingecko:matic-network",
    ("avax", "avax"): "coingecko:avalanche-2",
}
#: Token ids that count as stable.
STABLE_IDS = (
    "0x0000000000085d4780b73119b644ae5ecd22b376",
    "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48",
    "0xdac17f958d2ee523a2206206994597c13d831ec7",
    "0x6b175474e89094c44da98b954eedeac495271d0f",
    "0x0000000000000000000000000000000000000000",
)


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a small fixed table; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def asset_key(chain: Column, token: Column) -> Column:
    """Price key of a token: the native coin's, else mapped chain and 0x address, else null."""
    low = F.lower(token)
    native = lookup(F.concat_ws("|", chain, low), {f"{c}|{t}": v for (c, t), v in NATIVE.items()})
    mapped = F.when(low.startswith("0x"), F.concat(lookup(chain, PRICE_CHAINS), F.lit(":"), low))
    return F.when(F.coalesce(token, F.lit("")) != "", F.coalesce(native, mapped))


def leg_usd(amount: Column, price: Column) -> Column:
    """abs(amount * price); anything that is not a number counts as zero."""
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    return F.abs(number(amount) * number(price))


def gross_usd(sends: Column, receives: Column) -> Column:
    """The larger side of two arrays of legs' USD values, not their sum."""
    total = lambda side: F.aggregate(F.coalesce(side, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return F.greatest(total(sends), total(receives))


def action_class(approval: Column, cex: Column, project: Column, sends: Column, receives: Column) -> Column:
    """Factual class from what an event carries; sends and receives are booleans."""
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    side = lambda name: F.when(sends & receives, f"{name}_BIDIRECTIONAL").when(sends, f"{name}_OUT").when(receives, f"{name}_IN").otherwise(name)
    plain = F.when(sends & receives, "ASSET_EXCHANGE_LIKE").when(sends, "TRANSFER_OUT").when(receives, "TRANSFER_IN").otherwise("CONTRACT_INTERACTION")
    return F.when(filled(approval), "APPROVAL").when(filled(cex), side("CEX_INTERACTION")).when(filled(project), side("DEFI_INTERACTION")).otherwise(plain)


#: Control characters with a short escape in JSON.
SHORT_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_text(value: Column) -> Column:
    """A JSON string in printable ASCII, or null as such: other characters are escaped, those beyond 16 bits as two surrogates."""
    quoted = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')

    def ascii_only(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(c.between(" ", "~"), c).otherwise(F.coalesce(lookup(c, SHORT_ESCAPES), F.regexp_replace(units, "(.{4})", r"\\u$1")))

    escaped = F.when(quoted.rlike("[^ -~]"), F.array_join(F.transform(F.split(quoted, ""), ascii_only), "")).otherwise(quoted)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def event_id(entity: Column, wallet: Column, chain: Column, tx: Column, index: Column, ts: Column) -> Column:
    """sha256 of the compact JSON list of an event's identity."""
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", json_text(entity), json_text(F.lower(wallet)), json_text(chain), json_text(tx), number(index), number(ts)), F.lit("]")), 256)


def action_token(action: Column, cex: Column, project: Column, cate: Column) -> Column:
    """The action with its venue: exchange, else project, else category."""
    tag = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"@{name}:"), x))
    return F.concat(action, F.coalesce(tag("cex", cex), tag("project", project), tag("cate", cate), F.lit("")))


def whole_seconds(value: Column) -> Column:
    """int(float(x)); zero where that fails."""
    return F.coalesce(value.try_cast("double").try_cast("long"), F.lit(0))


def parse_epoch(value: Column) -> Column:
    """Seconds since 1970 from a number (over 1e10: milliseconds), numeric text or ISO time; null otherwise."""
    number = value.try_cast("double")
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    iso = F.regexp_replace(value.cast("string"), "Z$", "+00:00").try_cast("timestamp")
    return F.coalesce(seconds.try_cast("long"), F.unix_timestamp(iso))


def address_family(address: Column) -> Column:
    """evm, bitcoin or solana by the form of an address."""
    evm = address.startswith("0x") & (F.length(address) == 42)
    return F.when(evm, "evm").when(address.startswith("bc1") | address.startswith("1") | address.startswith("3"), "bitcoin").otherwise("solana")


def normal_address(address: Column) -> Column:
    """Only 0x addresses are lower-cased."""
    return F.when(F.lower(address).startswith("0x"), F.lower(address)).otherwise(address)
