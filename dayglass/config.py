"""Default parameters of the operators.

Fixed values: these must equal the values the results are compared against.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Datasets read when none are named, and the log kinds in each.
DATASETS = ("r1", "r2", "r3.1", "r3.2", "r4.1")
LOG_KINDS = ("logon", "device", "file", "email", "http")

# Words that make a host suspicious, extensions that make a file sensitive.
SUSPICIOUS_WORDS = ("temp", "anonymous", "proxy", "vpn", "leak", "hack")
SENSITIVE_EXTENSIONS = ("doc", "docx", "xls", "xlsx", "pdf", "txt", "sql", "db", "zip", "rar")

# Salt of the pseudonyms, large-mail limit, trait columns.
PSEUDONYM_SALT = "salty_salty_salt"
LARGE_EMAIL_BYTES = 1024 * 1024
TRAITS = ("O", "C", "E", "A", "N")

# Flags filled with 0 after the union of unlike logs.
FLAG_COLUMNS = (
    "is_logon",
    "is_logoff",
    "is_connect",
    "is_disconnect",
    "is_large_email",
    "has_attachment",
    "is_suspicious_domain",
    "is_sensitive_file",
)

# Split ratios and seed.
SEED = 42
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.7, 0.15, 0.15

# Sequence windows.
SEQUENCE_LENGTH = 15
LEGACY_STRIDE = 10
SELF_WINDOW_DAYS = 30
EPSILON = 1e-10


@dataclass(frozen=True)
class ForestParams:
    """Isolation forest (fixed values)."""

    trees: int = 50
    sample_size: int = 256
    seed: int = SEED


@dataclass(frozen=True)
class LatentParams:
    """Latent clustering (fixed values: 5 clusters, 10 restarts of 300 rounds, p95)."""

    clusters: int = 5
    restarts: int = 10
    max_iter: int = 300
    components: int | None = None
    quantile: float = 0.95
    seed: int = SEED


@dataclass(frozen=True)
class EnsembleParams:
    """Score weights and alert threshold (fixed values)."""

    weights: dict[str, float] = field(
        default_factory=lambda: {
            "isolation_forest": 0.3,
            "lstm_autoencoder": 0.4,
            "deep_clustering": 0.3,
        }
    )
    threshold: float = 0.7


# Order in which model results are listed.
MODELS = ("isolation_forest", "lstm_autoencoder", "deep_clustering")

# Severity bands, both ends inclusive, first match wins.
SEVERITY_BANDS = (
    ("low", 0.7, 0.8),
    ("medium", 0.8, 0.9),
    ("high", 0.9, 0.98),
    ("critical", 0.98, 1.0),
)
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# User-level ensembles of the earlier generation.
USER_WEIGHTS = {"isolation_forest": 0.4, "deep_clustering": 0.2, "lstm_autoencoder": 0.4}
FINAL_WEIGHTS = {"isolation_forest": 0.1, "deep_clustering": 0.1, "lstm_autoencoder": 0.8}
FINAL_THRESHOLD = 0.85

# Evaluation grids.
TOP_KS = (10, 50, 100, 500)
FPR_LEVELS = (0.01, 0.05, 0.10)
THRESHOLD_STEPS = 100
HISTOGRAM_BINS = 50
GRID_STEPS = 1000

# Aliases accepted in prediction files, first match wins.
SCORE_ALIASES = ("anomaly_score", "score", "reconstruction_error", "prediction")
LABEL_ALIASES = ("true_label", "is_insider", "label", "ground_truth")
USER_ALIASES = ("user_id", "user", "id")
