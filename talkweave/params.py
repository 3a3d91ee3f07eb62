"""Default thresholds. Changing any of them changes results."""

ECHO_TEMPORAL = 0.5          # overlap / shorter, strict >
ECHO_TEXT = 0.7              # Jaccard and containment, strict >
ECHO_EMBEDDING = 0.8         # cosine, strict >
SPEECH_PROBABILITY = 0.5     # region counts as speech, >=
SPEECH_FRACTION = 0.5        # share of a segment covered by speech, >=; <= 0 disables
QUALITY = 0.3                # diarizer quality, >=; missing counts as 1.0
RECONCILE_COSINE = 0.65      # >=
RECONCILE_KEEP = 0.9         # weight of the old reference embedding
SAMPLE_TOLERANCE_S = 0.3     # crosstalk beyond this spoils a sample, >
SAMPLE_MAX_S = 15.0
PAD_RATIO = 0.10             # >
PAD_MIN_TOTAL_S = 30.0       # >=
PAD_MIN_PADDED_S = 15.0      # >=
PAD_CLAMP_S = 60.0
PAD_MAX_DELTA_S = 86400.0
DRIFT_WINDOW_S = 5.0
DRIFT_BAND = (0.95, 1.05)
RETRY_CAP = 2                # give up above
RETRY_DECAY_S = 600.0        # a larger gap starts a new streak
COOLDOWN_S = 300.0           # a smaller gap suppresses
RING_EVENTS = 5000
RING_BYTES = 1_000_000
STICKY_RUN = 100
TOKEN_RATIO_DEFAULT = 3.0
TOKEN_RATIO_RANGE = (1.5, 6.0)
TOKEN_MIN_CHARS = 2000
TOKEN_MIN_TOKENS = 10        # strictly more than this
TOKEN_BLEND_NEW = 0.3
PROMPT_OVERHEAD_PCT = 10
OUTPUT_BUFFER = 2048
MAX_CONTEXT = 32768
CHUNK_MINUTES = 30
ARCHIVE_HOURS = 15
ARCHIVE_KBPS = 64
LOOKAHEAD_MINUTES = 10
ARCHIVE_TOLERANCE_S = 0.25
WAV_HEADER_BYTES = 44

UNKNOWN = "Unknown"

QUALITY_KINDS = ("excessivePadding", "rateDrift", "sustainedFormatDrop",
                 "systemAudioUnrecovered", "restartFailed", "captureSourceFallback")
HANDS_FREE_RATES = (8000, 16000, 24000, 32000)
RETRYABLE_STATUS = (429, 503)
DEFAULT_REGION = {
    "ar": "ar-SA", "de": "de-DE", "en": "en-US", "es": "es-ES", "fr": "fr-FR", "hi": "hi-IN",
    "it": "it-IT", "ja": "ja-JP", "ko": "ko-KR", "nl": "nl-NL", "pt": "pt-BR", "ru": "ru-RU",
    "tr": "tr-TR", "zh": "zh-CN",
}
FILE_LANGUAGES = ("de", "en", "es", "fi", "fr", "it", "ja", "ko", "pt", "tr", "zh")
ENGINE_LANGUAGES = {
    "fluid": ("bg", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "hr", "hu", "it", "lt", "lv",
              "nl", "no", "pl", "pt", "ro", "sk", "sl", "sv", "uk"),
}
