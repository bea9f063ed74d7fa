"""Point tables, token lists and patterns that results depend on."""

# Admission risk points as (lowest value, highest value, points)
GRACE_AGE = [(0, 39, 0), (40, 49, 18), (50, 59, 36), (60, 69, 55), (70, 79, 73), (80, 200, 91)]
GRACE_HEART_RATE = [
    (0, 69, 0), (70, 89, 7), (90, 109, 13), (110, 149, 23), (150, 199, 36), (200, 500, 46),
]
GRACE_SYSTOLIC = [
    (0, 79, 63), (80, 99, 58), (100, 119, 47), (120, 139, 37), (140, 159, 26), (160, 199, 11),
    (200, 500, 0),
]
GRACE_CREATININE = [
    (0.0, 0.39, 2), (0.4, 0.79, 5), (0.8, 1.19, 8), (1.2, 1.59, 11), (1.6, 1.99, 14),
    (2.0, 3.99, 23), (4.0, 100.0, 31),
]
GRACE_ARREST = 43
GRACE_ST = 30
GRACE_ENZYMES = 15
GRACE_KILLIP = {1: 0, 2: 21, 3: 43, 4: 43}
GRACE_BANDS = (108, 140)

TIMI_BANDS = (2, 4)

# Registry score points and the probability published per score
REGISTRY_POINTS = {
    "age_gt_70": 1,
    "sbp_lt_100": 1,
    "gfr_lt_60": 3,
    "ecg_leads_gt_7": 1,
    "killip_iv": 1,
    "vf_vt": 2,
    "high_grade_avb": 1,
}
REGISTRY_PROBABILITY = {
    0: 0.02, 1: 0.05, 2: 0.10, 3: 0.20, 4: 0.35, 5: 0.50, 6: 0.65, 7: 0.78, 8: 0.88, 9: 0.94,
    10: 0.98,
}
REGISTRY_MAX = 10

# Electrocardiogram lead columns
ECG_LEADS = [
    "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8", "v9", "d1", "d2", "d3", "avl", "avf", "avr",
]

# Complication tokens per family
TOKEN_SEPARATORS = r"[;,/|]+"
TOKENS_VF = ["fv", "pcr-fv"]
TOKENS_VT = ["tv"]
TOKENS_AVB_HIGH = ["bav3", "bav2:1", "bav2", "bav", "pcr-bav-pericar"]
TOKENS_AVB_LOW = ["bav1"]
TOKENS_SHOCK = ["shock", "shock_c"]
TOKENS_HEART_FAILURE = ["fallo_bomba", "congpulm", "eap"]
TOKENS_ARREST = ["pcr", "pcr-fv", "pcr-bav-pericar", "asist"]
TOKENS_OTHER_ARRHYTHMIA = ["farvr", "farva", "farvl", "arritmia", "ts", "bs"]
TOKENS_MECHANICAL = [
    "rupt p lib", "rupt tiv", "rupt muscp", "ruptura", "aneurap", "pseudoaneur", "taponam",
    "insmit", "i.mitral",
]

# Complication patterns on upper-case text
PATTERN_VF_VT_WORD = r"\bFV\b|\bTV\b"
PATTERN_AVB_WORD = r"BAV\s*3|BAV\s*2\s*:\s*1|BAV\-?3"
PATTERN_VF_VT_PART = "FV|TV"
PATTERN_AVB_PART = "BAV3|BAV2:1"

# Encodings of delimited text; the second takes any byte, so no third is ever reached
TEXT_ENCODINGS = ["utf-8", "iso-8859-1"]
SNAPSHOT_FORMAT = "yyyyMMdd_HHmmss"
SNAPSHOT_PATTERN = r"(\d{8}_\d{6})"

# Row identifiers that are never features
ID_COLUMNS = ["patient_id", "mrn", "admission_id"]
