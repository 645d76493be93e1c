"""Results depend on these exact strings and numbers.

Everything here is data, kept in one place so that no operator carries its own copy.
"""

from __future__ import annotations

# --- Fixed values: class ids of the region classifier (append-only) ---------------------
LABELS: dict[str, int] = {
    "standard": 0,
    "gangwondo": 1,
    "gyeongsangdo": 2,
    "jeollado": 3,
    "jejudo": 4,
    "chungcheongdo": 5,
}
STANDARD_LABEL = 0
REGIONS: tuple[str, ...] = tuple(name for name in LABELS if name != "standard")

# --- Fixed values: Korean region names and their codes ----------------------------------
REGION_NAMES: dict[str, str] = {
    "gangwondo": "강원도",
    "gyeongsangdo": "경상도",
    "jeollado": "전라도",
    "jejudo": "제주도",
    "chungcheongdo": "충청도",
}
REGION_CODES: dict[str, str] = {name: code for code, name in REGION_NAMES.items()}

# --- Fixed values: folder and file-name conventions of the transcript corpora -----------
SPLIT_FOLDERS: dict[str, str] = {"Training": "train", "Validation": "valid"}
SPEECH_PREFIXES: dict[str, str] = {"st_": "read", "say_": "say", "talk_": "talk"}
REGION_IN_PATH = r"_([가-힣]+도)_"
LEGACY_REGION_IN_PATH = r"한국어 방언 발화\((.+?)\)"

# --- Fixed values: characters Python's str.strip()/str.split() treat as blank -----------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: punctuation that may cling to either end of a word -------------------
WORD_EDGE_PUNCTUATION = (
    ".,!?;:\"'()[]{}<>"
    "．，！？；：…·"
    "「」『』《》〈〉“”‘’"
    "~`@#$%^&*-_=+/\\|"
)

# --- Fixed values: sentence endings that betray dialect in a "standard" text ------------
DIALECT_ENDINGS: tuple[str, ...] = (
    "카노", "카나", "카니", "캤", "했능교", "능교", "하이소", "마이소", "이라예",
    "거든예", "랍니더", "심더", "니더", "아입니", "아이가", "드래요", "드래여",
)

# --- Fixed values: contour markers and the two marker policies --------------------------
MARKERS: tuple[str, ...] = ("<UP>", "<DOWN>", "<WAVE>", "<KEEP>")
VOICED_MIN_HZ = 30.0
VOICED_MIN_POINTS = 3
MARKER_POLICIES: dict[int, dict] = {
    1: {"version": 1, "up": 0.15, "down": -0.15, "wave_on": "range", "wave": 50.0},
    2: {"version": 2, "up": 0.05, "down": -0.40, "wave_on": "cv", "wave": 0.30},
}
CURRENT_MARKER_POLICY = 2
SENTENCE_FINAL = ".?!。！？"

# --- Fixed values: prompt wording --------------------------------------------------------
SYSTEM_PROMPTS: dict[str, str] = {
    "default": "당신은 한국어 방언 변환 전문가입니다.",
    "prosody": (
        "당신은 한국어 방언 변환 전문가입니다. "
        "문장의 어미와 억양, 종결 표현을 자연스럽게 살려서 변환하세요."
    ),
}
TO_DIALECT_PROMPT = "다음 문장을 %s 사투리로 바꿔줘:\n%s"
TO_STANDARD_PROMPT = "다음 %s 사투리를 표준어로 바꿔줘:\n%s"
BACK_TRANSLATION_PROMPT = "다음 방언 문장을 표준어로 바꿔줘.\n방언: %s\n표준어: "

# --- Fixed values: evaluation metrics (key, higher is better, group, meaning, caveat) ---
METRIC_SPECS: tuple[tuple[str, bool, str, str, str], ...] = (
    ("reconstruction_bleu", True, "selection", "BLEU of the back-translation against the source", "ranking metric, independent of proxies"),
    ("copy_margin", True, "dialectness", "chrF to gold minus chrF to source", "negative when the output copies its input"),
    ("tdr", True, "dialectness", "share of outputs classified as the target region", "classifier proxy, monitoring only"),
    ("dfs", True, "dialectness", "log ratio of similarity to gold and to source embeddings", "embedding proxy, monitoring only"),
    ("chrf", True, "surface", "character F-score against gold", "copy-biased where gold is close to source"),
    ("bleu", True, "surface", "BLEU against gold", "copy-biased where gold is close to source"),
    ("eojeol_accuracy", True, "dialectness", "share of expected dialect words found in the output", "lexical signal"),
    ("chrf_source", False, "surface", "character F-score against the source", "lower is better, used for the margin"),
    ("jscore", True, "monitoring", "geometric mean of four remapped axes", "overlaps the training scores, never select on it"),
)
UNREGISTERED_METRIC = (True, "monitoring", "(unregistered metric)", "")
LEADERBOARD_METRICS: tuple[str, ...] = (
    "reconstruction_bleu", "copy_margin", "tdr", "dfs", "chrf", "bleu", "eojeol_accuracy", "jscore",
)
CONVERSION_AXIS = "copy_margin"
FIDELITY_AXIS = "reconstruction_bleu"

# --- Fixed values: native output range of every row score -------------------------------
SCORE_RANGES: dict[str, tuple[float, float]] = {
    "style": (-1.0, 1.0),
    "content": (0.0, 1.0),
    "edit": (0.0, 1.0),
    "edit_precision": (0.0, 1.0),
    "edit_recall": (0.0, 1.0),
    "copy_margin": (0.0, 1.0),
    "overcorrection": (0.0, 1.0),
    "reconstruction": (0.0, 1.0),
    "fluency": (0.0, 1.0),
    "length": (0.0, 1.0),
}
DEFAULT_SCORES: tuple[tuple[str, float], ...] = (("style", 1.0), ("content", 0.5))

# Repairs of the known damage of the transcript files, in the order in which they apply.
REPAIR_REMOVED = "\n\t"
REPAIR_PATTERNS = ((", +\\}", ",}"), (", +\\]", ",]"))
REPAIR_TEXTS = ((",}", "}"), (",]", "]"), ("'", '"'), (".,", ","))
REPAIR_DOUBLE_COMMA = r'(?U)([}\]])\s*,\s*,\s*(?="[^"]+"\s*:)'
