"""Column contract of a panel: keys, features, responders, weight."""

from __future__ import annotations

ID_COLUMNS: list[str] = ["date_id", "time_id", "symbol_id"]
DATE, TIME, SYMBOL = ID_COLUMNS
FEATURE_COLUMNS: list[str] = [f"feature_{i:02d}" for i in range(79)]
RESPONDER_COLUMNS: list[str] = [f"responder_{i}" for i in range(9)]
AUX_RESPONDERS: list[str] = ["responder_9", "responder_10"]
LAG_COLUMNS: list[str] = [f"responder_{i}_lag_1" for i in range(9)]
TARGET_COLUMN = "responder_6"
WEIGHT_COLUMN = "weight"

# --- fixed values (must equal the reference for identical subsets) ----------
# All 79 features ranked by split importance of the reference's boosted-tree run;
# the named subsets are prefixes of this ranking.
FEATURE_IMPORTANCE_RANKING: list[str] = [
    "feature_61", "feature_20", "feature_24", "feature_08", "feature_21", "feature_22",
    "feature_25", "feature_31", "feature_30", "feature_07", "feature_38", "feature_05",
    "feature_26", "feature_23", "feature_29", "feature_27", "feature_28", "feature_01",
    "feature_58", "feature_60", "feature_04", "feature_37", "feature_47", "feature_33",
    "feature_36", "feature_15", "feature_69", "feature_77", "feature_59", "feature_06",
    "feature_56", "feature_78", "feature_11", "feature_70", "feature_09", "feature_17",
    "feature_50", "feature_74", "feature_72", "feature_67", "feature_14", "feature_73",
    "feature_02", "feature_62", "feature_52", "feature_49", "feature_12", "feature_53",
    "feature_34", "feature_42", "feature_39", "feature_68", "feature_57", "feature_45",
    "feature_00", "feature_32", "feature_76", "feature_35", "feature_75", "feature_66",
    "feature_10", "feature_03", "feature_55", "feature_18", "feature_46", "feature_64",
    "feature_48", "feature_65", "feature_19", "feature_16", "feature_44", "feature_41",
    "feature_51", "feature_13", "feature_71", "feature_54", "feature_40", "feature_43",
    "feature_63",
]
SUBSET_SIZES: dict[str, int | None] = {"top12": 12, "top24": 24, "all": None}
DEFAULT_ROLLING_WINDOW = 1000
# Auxiliary target sets (ordered right-hand sides of the multi-target model).
AUX_TARGET_SETS: dict[str, list[str]] = {
    "base4": ["responder_10", "responder_9", "responder_8", "responder_7"],
    "target_family": ["responder_6", "responder_7", "responder_8", "responder_9", "responder_10"],
    "all9": [f"responder_{i}" for i in range(9)],
    "all11": [f"responder_{i}" for i in range(11)],
}
# Forward shifts (in rows of the symbol's series) of the synthetic aux targets.
AUX9_LEADS = (4,)
AUX10_LEADS = (20, 40)
# --- end of fixed values ------------------------------------------------------


def subset_features(subset: str, ranking: list[str] | None = None) -> list[str]:
    """Named prefix of an importance ranking (``top12`` / ``top24`` / ``all``)."""
    if subset not in SUBSET_SIZES:
        raise ValueError(f"unknown subset {subset!r}; choose from {', '.join(SUBSET_SIZES)}")
    rank = FEATURE_IMPORTANCE_RANKING if ranking is None else ranking
    k = SUBSET_SIZES[subset]
    return list(rank if k is None else rank[:k])
