"""Table schemas and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_hash", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("creation_timestamp", T.DoubleType()),
        T.StructField("timestamp_source", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("frame_count", T.IntegerType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("point_ids", T.ArrayType(T.StringType())),
        T.StructField("embedded_at", T.DoubleType()),
        T.StructField("scanned_at", T.DoubleType()),
        T.StructField("updated_at", T.DoubleType()),
    ]
)

META = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("updated_at", T.DoubleType()),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("point_id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("source_offset", T.DoubleType()),
        T.StructField("creation_timestamp", T.DoubleType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("granularity", T.StringType()),
        T.StructField("scene_id", T.IntegerType()),
        T.StructField("scene_start", T.DoubleType()),
        T.StructField("scene_end", T.DoubleType()),
        T.StructField("scene_frame_count", T.LongType()),
        T.StructField("is_scene_representative", T.BooleanType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

TIMELINE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("segment_type", T.StringType()),
        T.StructField("start_offset", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("time_bucket", T.LongType()),
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("decode_qsize", T.LongType()),
        T.StructField("index_qsize", T.LongType()),
        T.StructField("cpu_percent", T.DoubleType()),
        T.StructField("memory_rss_mb", T.DoubleType()),
        T.StructField("system_cpu_percent", T.DoubleType()),
        T.StructField("system_ram_percent", T.DoubleType()),
        T.StructField("warning", T.StringType()),
    ]
)

JOB_EVENTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("progress_pct", T.DoubleType()),
        T.StructField("stage", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

# --- fixed values: results must equal the reference's, so these are stated as they are ----------

IMAGE_SUFFIXES = (".heic", ".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif")
VIDEO_SUFFIXES = (".mov", ".mp4", ".m4v", ".avi", ".mkv")

# ISO base-media brands in bytes 9..12 of the header
IMAGE_BRANDS = ("heic", "heix", "hevc", "heca", "mif1", "msf1")
VIDEO_BRANDS = ("qt  ", "mp41", "mp42", "isom", "avc1", "M4V ")

MIME_BY_SUFFIX = {
    ".heic": "image/heic",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".mov": "video/quicktime",
    ".mp4": "video/mp4",
    ".m4v": "video/x-m4v",
    ".avi": "video/x-msvideo",
    ".mkv": "video/x-matroska",
}

STATUSES = ("PENDING", "SCANNED", "EXTRACTED", "EMBEDDED", "INDEXED", "ERROR")
ALLOWED_TRANSITIONS = {
    "PENDING": ("SCANNED", "ERROR"),
    "SCANNED": ("EXTRACTED", "EMBEDDED", "INDEXED", "ERROR", "PENDING"),
    "EXTRACTED": ("EMBEDDED", "INDEXED", "ERROR", "SCANNED"),
    "EMBEDDED": ("INDEXED", "ERROR", "SCANNED"),
    "INDEXED": ("SCANNED", "PENDING", "ERROR"),
    "ERROR": ("PENDING", "SCANNED", "EXTRACTED", "EMBEDDED", "INDEXED"),
}

# live-photo companions, in order of preference
STILL_SUFFIXES = (".heic", ".heif", ".jpg", ".jpeg", ".png")
COMPANION_SUFFIXES = (".MOV", ".mov", ".mp4", ".MP4")

SIGNALS = ("cosine", "nima", "sharpness", "contrast", "colorfulness", "epic_sim", "technical")
DEFAULT_SIGNALS = ("cosine", "nima", "technical")
# signal -> key of the score map it reads
SCORE_KEYS = {
    "nima": "nima_aesthetic",
    "sharpness": "sharpness",
    "contrast": "contrast",
    "colorfulness": "colorfulness",
    "technical": "technical_composite",
}

PROFILES = {
    "cinematic": {
        "weights": {
            "cosine": 0.40,
            "nima": 0.30,
            "sharpness": 0.05,
            "contrast": 0.035,
            "colorfulness": 0.015,
            "epic_sim": 0.20,
            "technical": 0.10,
        },
        "segments_factor": 0.8,
        "clips_per_file": 2,
    },
    "personal": {
        "weights": {
            "cosine": 0.50,
            "nima": 0.15,
            "sharpness": 0.125,
            "contrast": 0.0875,
            "colorfulness": 0.0375,
            "epic_sim": 0.10,
            "technical": 0.25,
        },
        "segments_factor": 1.2,
        "clips_per_file": 2,
    },
    "journey": {
        "weights": {
            "cosine": 0.45,
            "nima": 0.45,
            "sharpness": 0.05,
            "contrast": 0.035,
            "colorfulness": 0.015,
            "epic_sim": 0.15,
            "technical": 0.10,
        },
        "segments_factor": 1.0,
        "clips_per_file": 2,
    },
}

# re-ranking presets: cosine, nima, sharpness, contrast, colorfulness, technical
PRESETS = {
    "cinematic": (0.40, 0.30, 0.05, 0.035, 0.015, 0.10),
    "personal": (0.50, 0.15, 0.125, 0.087, 0.037, 0.25),
    "journey": (0.50, 0.20, 0.075, 0.052, 0.022, 0.15),
    "cosine_only": (1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "aesthetic_heavy": (0.30, 0.50, 0.05, 0.05, 0.0, 0.10),
    "clarity": (0.30, 0.10, 0.35, 0.15, 0.0, 0.10),
}
PRESET_SIGNALS = ("cosine", "nima", "sharpness", "contrast", "colorfulness", "technical")

MIN_SCORE = 0.08
FALLBACK_CANDIDATES = 10
MISSING_SCORE = 0.5
IMAGE_SECONDS = 2.5
VIDEO_SECONDS = 4.0
VIDEO_SECONDS_RANGE = (2.0, 6.0)
APPROVAL_SCORE = 7.5
PAN_ZOOM_CYCLE = ("zoom_in", "pan_right", "zoom_out", "pan_left")
DATE_PATTERNS = (
    "yyyy:MM:dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy:MM:dd HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy:MM:dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
)
PROMPT_PREFIXES = ("a photo of", "a picture of", "a video of")
