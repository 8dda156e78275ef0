"""Parameters of the operators, with the service defaults."""

from dataclasses import dataclass

US = 1_000_000


@dataclass(frozen=True)
class FeatureOptions:
    """Windows of the history features and the limits that decide when a user is split.

    A user with more than `hot_rows` rows is cut into time slices of about `slice_rows` rows, so
    the table of such users never has more than (rows / hot_rows) entries. Tasks get about `task_rows` rows each.
    """

    short_window_s: int = 3600
    long_window_s: int = 86400
    merchant_ttl_s: int = 86400
    country_ttl_s: int = 7 * 86400
    moments_ttl_s: int = 30 * 86400
    distinct_mode: str = "ttl"
    hot_rows: int = 5_000_000
    slice_rows: int = 2_000_000
    broadcast_rows: int = 1_000_000
    task_rows: int = 1 << 16


@dataclass(frozen=True)
class ScoringOptions:
    review_threshold: float = 0.4
    block_threshold: float = 0.75
    prediction_lifetime_s: int = 3600


@dataclass(frozen=True)
class TrainingOptions:
    seed: int = 42
    train_tenths: int = 8
    val_tenths: int = 1
    rounds: int = 800
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    column_sample: float = 0.8
    min_rows_per_leaf: int = 10
    ridge: float = 1.0
    bins: int = 64
    leaves: int = 31
    patience: int = 50
    chunk: int = 10
    serve: str = "ensemble"
    model_name: str = "fraud-detector"


@dataclass(frozen=True)
class MonitorOptions:
    report_interval_s: int = 300
    buffer_threshold: int = 100
    batch_size: int = 2000
    drift_share: float = 0.3


@dataclass(frozen=True)
class StreamOptions:
    """Topics of the live pipeline. Progress is kept in the query's checkpoint, not in a group."""

    bootstrap_servers: str = "localhost:9092"
    raw_topic: str = "transactions.raw"
    features_topic: str = "transactions.features"
    dead_letter_topic: str = "transactions.raw.dlq"
    starting_offsets: str = "latest"
    rows_per_trigger: int = 1_000_000
    linger_ms: int = 2
    compression: str = "snappy"
