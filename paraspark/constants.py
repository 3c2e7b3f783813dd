"""Fixed values.

These must equal the values the source scripts use, otherwise prompts, buckets and record ids
come out different.  They are stated here plainly, in natural order, and used everywhere else by
name.
"""

# ---- Fixed values: system prompts of the structured chat examples, keyed by direction ----
SYSTEM_PROMPTS = {
    "en-es": (
        "You are a professional medical translator. Translate English clinical "
        "scenarios into strictly correct, fluent Spanish medical terminology. "
        "Output only the Spanish translation."
    ),
    "es-en": (
        "You are a professional medical translator. Translate Spanish clinical "
        "scenarios into strictly correct, fluent English medical terminology. "
        "Output only the English translation."
    ),
}

# ---- Fixed values: system prompts of the simple evaluation template ----
SIMPLE_SYSTEM_PROMPTS = {
    "en-es": "Translate the following English medical text into Spanish.",
    "es-en": "Translate the following Spanish medical text into English.",
}

# ---- Fixed values: system prompt of the baseline multi-model translation ----
BASELINE_SYSTEM_PROMPT = (
    "You are a professional medical translator. Translate the following English clinical "
    "scenario into strictly correct, fluent Spanish medical terminology. Output ONLY the "
    "Spanish translation without any explanations or additional text."
)

# ---- Fixed values: language names per direction (source, target) ----
DIRECTION_LANGUAGES = {
    "en-es": ("English", "Spanish"),
    "es-en": ("Spanish", "English"),
}
DIRECTIONS = ("en-es", "es-en")

# ---- Fixed values: generation stop markers, in the order they are checked ----
STOP_MARKERS = ("<|im_end|>", "<|endoftext|>", "<|im_start|>")

# ---- Fixed values: prompt-only chat markup ----
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"

# ---- Fixed values: display names of the plain chat rendering ----
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
DEFAULT_ROLE_NAME = "Message"

# ---- Fixed values: direction inference markers (checked in this order) ----
ES_EN_MARKERS = ("Spanish to English", "Spanish:")
EN_ES_MARKERS = ("English to Spanish", "English:")
UNKNOWN_DIRECTION = "unknown"

# ---- Fixed values: length buckets, inclusive upper bound and label ----
LENGTH_BUCKETS = (
    (512, "0_512"),
    (1024, "512_1k"),
    (2048, "1k_2k"),
    (4096, "2k_4k"),
    (6144, "4k_6k"),
    (8192, "6k_8k"),
)
OVERFLOW_BUCKET = "8k_plus"

# ---- Fixed values: required pair fields ----
REQUIRED_PAIR_FIELDS = ("term", "target_length", "style", "english_scenario", "spanish_translation")

# ---- Fixed values: defaults of the source scripts ----
DEFAULT_SEED = 42
DEFAULT_VALIDATION_RATIO = 0.02
DEFAULT_MAX_SEQ_LEN = 512
DEFAULT_VALIDATION_CAP = 512
DEFAULT_BATCH_SIZE = 8
DEFAULT_CALIBRATION_SIZE = 128
DEFAULT_TASK_PREFIX = "medical_translation"
PROMPT_ONLY_MODE = "prompt_only"
LABEL_IGNORE = -100
CHRF_MAX_ORDER = 6
CHRF_BETA = 2.0
SOURCE_MARKERS = ("\nEnglish: ", "English: ")
ERROR_VALUE = "ERROR"
NO_METRICS_NOTE = "No reference_text column was provided, so automatic metrics were skipped."
