"""Dimension data: sources and their priors, the watch list, noise patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# They decide results and so are stated as they are.

SOURCE_PRIORS = {
    "coindesk": 0.80, "theblock": 0.80, "decrypt": 0.70, "cointelegraph": 0.65, "bitcoinmagazine": 0.60, "cryptoslate": 0.60,
    "cryptonews": 0.55, "ft_markets": 0.90, "cnbc": 0.85, "marketwatch": 0.80, "benzinga": 0.60, "investing": 0.65,
    "seekingalpha": 0.55, "fed": 0.95, "sec": 0.95, "reuters": 0.95,
}
DEFAULT_PRIOR = 0.50
AGGREGATOR = "cryptopanic"
AGGREGATOR_PRIOR = 0.50
TITLE_NOISE = (r"\bEarnings Preview$", r"\bPrice Prediction\b", r"^(Stock|Crypto) Market Today:")
MARKET_SYMBOLS = ("BTC", "ETH", "SOL", "SPY", "NVDA", "AAPL", "COIN")


@dataclass(frozen=True)
class Symbol:
    symbol: str
    asset_class: str
    aliases: tuple[str, ...] = ()
    bare: bool = True
    legacy: tuple[str, ...] = ()
    context: str | None = None
    not_before: tuple[str, ...] = ()


def _crypto(symbol: str, *aliases: str, **more) -> Symbol:
    return Symbol(symbol, "crypto", aliases, **more)


def _equity(symbol: str, *aliases: str, **more) -> Symbol:
    return Symbol(symbol, "equity", aliases, **more)


# The symbols, their names and the rules for reading them.
WATCH = (
    _crypto("BTC", "Bitcoin", "bitcoin", "BTC"),
    _crypto("ETH", "Ethereum", "Ether", not_before=("Zurich",)),
    _crypto("SOL", "Solana"),
    _crypto("XRP", "Ripple", context="crypto"),
    _crypto("DOGE", "Dogecoin", "dogecoin", bare=False),
    _crypto("ADA", "Cardano", bare=False),
    _crypto("AVAX", "Avalanche", context="crypto"),
    _crypto("DOT", "Polkadot", bare=False),
    _crypto("LINK", "Chainlink"),
    _crypto("UNI", "Uniswap"),
    _crypto("LTC", "Litecoin"),
    _crypto("BNB"),
    _crypto("TRX", "Tron", "TRON", context="crypto"),
    _crypto("TON", "Toncoin", bare=False),
    _crypto("SUI"),
    _crypto("HYPE", "Hyperliquid", bare=False),
    _crypto("POL", legacy=("MATIC",)),
    _equity("AAPL", "Apple", context="market", not_before=("pie", "cider", "orchard")),
    _equity("MSFT", "Microsoft"),
    _equity("NVDA", "Nvidia", "NVIDIA"),
    _equity("META", "Meta Platforms", "Meta", bare=False, context="market"),
    _equity("COIN", "Coinbase", bare=False),
    _equity("TSLA", "Tesla", context="market"),
    _equity("AMZN", "Amazon", context="market", not_before=("rainforest", "River", "basin")),
    _equity("GOOGL", "Alphabet", "Google"),
    _equity("MSTR", "MicroStrategy"),
    _equity("HOOD", "Robinhood", bare=False),
    _equity("JPM", "JPMorgan", "JPMorgan Chase"),
    _equity("GS", "Goldman Sachs", bare=False),
    _equity("SPY", "S&P 500"),
)
STOPLIST = frozenset(
    "AI CEO CFO CTO USA US UK EU ETF ETFs NEAR LINK UNI ONE IPO SEC FED GDP CPI PCE FOMC IT ALL ARE FOR NOW NEW OPEN BIG CAN SO ON AT BE "
    "GO HAS TV API NFT DAO DEX CEX TVL ATH USD USDT USDC OP APT IMF DOJ CFTC FBI OK A I S Q1 Q2 Q3 Q4".split()
)


@dataclass(frozen=True)
class Watchlist:
    """Symbols that texts are searched for; ``universe`` adds symbols that cashtags and exchange forms may name."""

    symbols: tuple[Symbol, ...] = WATCH
    stoplist: frozenset[str] = STOPLIST
    universe: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if not all(isinstance(x, str) for x in self.stoplist):
            raise TypeError("the stoplist must hold strings")

    @staticmethod
    def spelled(symbols: list[str]) -> frozenset[str]:
        """A universe with both spellings of share classes (a dot or a dash)."""
        return frozenset(s for x in symbols for s in (x, x.replace(".", "-")))


def prior(source: Column) -> Column:
    """A source's credibility prior: the aggregator with or without a domain, then the table, then the default."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_PRIORS.items() for x in pair])
    relayed = (source == AGGREGATOR) | source.startswith(f"{AGGREGATOR}:")
    return F.when(relayed, F.lit(AGGREGATOR_PRIOR)).otherwise(F.coalesce(table[source], F.lit(DEFAULT_PRIOR)))


def priors(spark: SparkSession) -> DataFrame:
    """The table as rows (source, prior)."""
    return spark.createDataFrame(list(SOURCE_PRIORS.items()), "source string, prior double")
