"""Schemas and domain constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the domain: the 10-20 montage, recording settings, bands, regions and rule limits.
CHANNELS = ["Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz", "C4", "T4", "T5", "P3", "Pz", "P4", "T6", "O1", "O2"]
SAMPLING_HZ = 500.0
BAND_PASS_HZ = (0.5, 50.0)
NOTCH_HZ = 50.0
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (12.0, 30.0), "gamma": (30.0, 50.0)}
SCALP_REGIONS = {"frontopolar": ["Fp1", "Fp2"], "frontal": ["F7", "F3", "Fz", "F4", "F8"], "temporal": ["T3", "T4", "T5", "T6"], "central": ["C3", "Cz", "C4"], "parietal": ["P3", "Pz", "P4"], "occipital": ["O1", "O2"]}
PEAK_REGIONS = {"eog": ["frontopolar", "frontal"], "muscle": ["temporal"]}
REJECT_UV, FLAT_UV, WARN_RATE = 250.0, 0.1, 0.30
AMBIGUOUS = (0.7, 1.4)
MAX_EXCLUDED, FOCALITY, MUSCLE_THRESHOLD = 5, 2.0, 0.9
EPOCH_S, EPOCH_CAP = 1.5, 300
BOUNDARY_WINDOW_S, BOUNDARY_TRIM_S, BOUNDARY_MIN_FRACTION, BOUNDARY_PERMUTATIONS = 4.0, 15.0, 0.10, 200
BOUNDARY_PLAUSIBLE, BOUNDARY_ALPHA, BOUNDARY_TOLERANCE = (0.25, 0.75), 0.05, 0.08
TEST_SHARE, FOLDS, SEED = 0.15, 5, 42


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

MANIFEST = _struct(("subject_id", S), ("group", S), ("split", S), ("eoec_path", S), ("vcpt_path", S))
PREDICTIONS = _struct(("subject_id", S), ("true_label", S), ("pred_prob", D), ("pred_label", S), ("fold", S))
QC_AUDIT = _struct(("subject_id", S), ("group", S), ("split", S), ("rej_ec", D), ("rej_eo", D), ("rej_vcpt", D), ("capped_eoec", B), ("capped_vcpt", B), ("muscle_flagged_eoec", I), ("muscle_flagged_vcpt", I), ("eoec_ambiguous", B))
BOUNDARIES = _struct(("subject_id", S), ("boundary_frac", S), ("trusted", S))
BUILD_LOG = _struct(("subject_id", S), ("group", S), ("split", S), ("status", S), ("n_ec", I), ("n_eo", I), ("n_vcpt", I), ("split_rule", S), ("boundary_frac", D), ("detail", S))
RECORDING = _struct(("path", S), ("channel", S), ("sfreq", D), ("signal", T.ArrayType(D)))
