"""Fixed values of the media catalog domain.

Everything in this file is data that results must agree with: categories,
format and codec tables, level limits, ladder rungs, site addresses.
"""

from __future__ import annotations

# --- tags (fixed values) ---
CATEGORIES = (
    "creator", "artist", "prompter", "ai", "set", "comic", "copyright", "rating", "species",
    "character", "character-group", "gender", "lore", "meta", "error", "style", "content",
)
PREFIXED_CATEGORIES = ("creator", "artist", "prompter", "ai", "set", "character")
ALBUM_CATEGORIES = ("set", "comic")
CREATOR_CATEGORIES = ("creator", "artist", "prompter")
# Characters with a meaning in search text; an alias with one cannot be typed there.
RESERVED_ALIAS_CHARACTERS = "(){}[]!&|"

# Built-in tags: (title, category, aliases) (fixed values).
DEFAULT_TAGS = (
    ("safe", "rating", ("safe",)),
    ("vector", "content", ("vector",)),
    ("sketch", "style", ("sketch",)),
    ("simple background", "content", ("simple background", "simple_background")),
    ("screencap", "meta", ("screencap",)),
    ("photography (artwork)", "meta", ("photography (artwork)", "photography_(artwork)", "photo")),
    ("ai content", "ai", ("ai content", "ai_content")),
    ("ai generated", "ai", ("ai: ai generated", "ai:generated")),
    ("comic", "meta", ("comic",)),
)
DEFAULT_IMPLICATION = (("ai generated", "ai"), ("ai content", "ai"))
UNAESTHETIC = ("vector", "sketch", "simple background", "screencap", "photo", "comic")

# --- representation kinds and levels (fixed values) ---
AUDIO, IMAGE, VIDEO = 0, 10, 20
REPR_KIND_OF_CONTENT = {"audio": AUDIO, "image": IMAGE, "video": VIDEO, "video-loop": VIDEO}
LEVEL_LABELS = {
    4: "CL4 Supercomputer",
    3: "CL3 Personal Computer",
    2: "CL2 Mobile device",
    1: "CL1 Old hardware",
    0: "CL0 Very old hardware",
}
DEFAULT_LEVEL = 2

# --- file formats (fixed values) ---
FORMAT_BY_SUFFIX = {
    ".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG", ".jfif": "JPEG", ".gif": "GIF",
    ".mp4": "MPEG 4", ".m4v": "MPEG 4", ".webp": "WEBP", ".webm": "WEBM", ".avif": "AVIF",
    ".svg": "SVG", ".mov": "MOV",
}
SUFFIX_BY_FORMAT = {
    "PNG": ".png", "JPEG": ".jpeg", "GIF": ".gif", "MPEG 4": ".mp4", "WEBP": ".webp",
    "WEBM": ".webm", "AVIF": ".avif", "SVG": ".svg", "MOV": ".mov",
}
MIME_BY_FORMAT = {
    "PNG": "image/png", "JPEG": "image/jpeg", "GIF": "image/gif", "MPEG 4": "video/mp4",
    "WEBP": "image/webp", "WEBM": "video/webm", "AVIF": "image/avif", "SVG": "image/svg+xml",
    "MOV": "video/quicktime",
}
NOT_ACCEPTED_FORMATS = ("MOV",)
FORMAT_BY_MIME = {mime: fmt for fmt, mime in MIME_BY_FORMAT.items()}
SUFFIX_BY_MIME = {mime: SUFFIX_BY_FORMAT[fmt] for fmt, mime in MIME_BY_FORMAT.items()}
ANIMATED_IMAGE_FORMATS = ("GIF", "PNG")
FILE_NAME_LIMIT = 512
FILE_NAME_RESERVE = 8

# Longest side per image level, lowest level first, and the floor set by the format.
IMAGE_SIDE_LIMITS = ((0, 1024), (1, 2048), (2, 4096), (3, 8192))
IMAGE_FORMAT_FLOOR = {
    "PNG": 0, "JPEG": 0, "GIF": 0, "MPEG 4": 0, "WEBP": 1, "WEBM": 1, "AVIF": 2, "SVG": 3,
}

# Ladder rungs: side -> (format, quality, effort); null effort is the encoder's default.
LADDER = {
    128: ("WEBP", 80, None),
    256: ("WEBP", 85, None),
    512: ("WEBP", 90, None),
    1024: ("WEBP", 95, 5),
    2048: ("AVIF", 90, 3),
    4096: ("AVIF", 85, None),
}
SVG_TOP_RUNG = 2048
KEEPS_SOURCE_BYTES = ("JPEG", "WEBP")

# --- codecs and containers (fixed values) ---
VIDEO_CODECS = {"h264": "H264", "avc": "H264", "vp8": "VP8", "vp9": "VP9", "av1": "AV1"}
AUDIO_CODECS = {"aac": "AAC", "vorbis": "Vorbis", "opus": "Opus"}
CONTAINER_VIDEO = {"MP4": ("H264",), "WEBM": ("VP8", "VP9", "AV1")}
CONTAINER_AUDIO = {"MP4": ("AAC", "Opus"), "WEBM": ("Vorbis", "Opus")}
AUDIO_LEVEL = {"AAC": 0, "Vorbis": 1, "Opus": 1}
UNFIT_LEVEL = 100
TOP_VIDEO_LEVEL = 4
BITS_BY_PIXEL_FORMAT = {"yuv420p": 8, "yuv420p10le": 10}
# codec, level, longest side, shortest side, frames per second, bits, kbit/s
VIDEO_LEVELS = (
    ("H264", 0, 1920, 1080, 30, 8, 20_000),
    ("H264", 1, 1920, 1080, 60, 8, 60_000),
    ("VP8", 1, 1280, 720, 30, 8, 6_000),
    ("VP8", 2, 1920, 1080, 60, 8, 40_000),
    ("VP9", 1, 1280, 720, 30, 8, 5_000),
    ("VP9", 2, 1920, 1080, 60, 8, 60_000),
    ("VP9", 3, 3840, 2160, 60, 10, 120_000),
    ("AV1", 2, 1280, 720, 30, 10, 5_000),
    ("AV1", 3, 1920, 1080, 60, 10, 40_000),
    ("AV1", 4, 3840, 2160, 60, 10, 100_000),
)
FPS_TOLERANCE = 1.0125
FPS_LIMIT_TOLERANCE = 1.05
LOOP_SECONDS = 30.0
# codec -> (container, suffix, mime, audio codec that goes with the container)
VIDEO_HOME = {
    "H264": ("MP4", ".mp4", "video/mp4", "AAC"),
    "VP8": ("WEBM", ".webm", "video/webm", "Opus"),
    "VP9": ("WEBM", ".webm", "video/webm", "Opus"),
    "AV1": ("WEBM", ".webm", "video/webm", "Opus"),
}
AUDIO_HOME = {
    "AAC": ("m4a", ".m4a"),
    "Vorbis": ("ogg", ".oga"),
    "Opus": ("opus", ".opus"),
}
H264_PROFILES = {"Baseline": 0x42, "Main": 0x4D, "High": 0x64, "High 10": 0x6E}
AV1_PROFILES = {"Main": "0", "High": "1", "Professional": "2"}
AAC_PROFILES = {"LC": "2", "HE-AAC": "5", "HE-AACv2": "29"}
NO_LEVEL = -99
ALPHA_PIXEL_FORMATS = ("rgba", "bgra", "argb", "abgr", "yuva", "ya8", "ya16", "gbrap", "ayuv")
HARDWARE_PIXEL_FORMATS = ("vaapi", "cuda", "dxva2", "vulkan", "bayer", "qsv")
FRONT_COVERS = ("cover.jpg", "front.jpg")
CONTAINER_RESERVE_KBPS = {"VP9": 150, "AV1": 200}
AUDIO_KBPS = {"VP9": 96, "AV1": 128}
AUDIO_RESERVE_FACTOR = 1.4
MIN_VIDEO_KBPS = 1000

# --- origin sites (fixed values) ---
# site -> (name prefix, address template); ids are one path element.
SIMPLE_SITES = {
    "derpibooru": ("db", "https://derpibooru.org/images/{}"),
    "ponybooru": ("pb", "https://ponybooru.org/images/{}"),
    "twibooru": ("tb", "https://twibooru.org/{}"),
    "e621": ("ef", "https://e621.net/posts/{}"),
    "e6ai": ("ea", "https://e6ai.net/posts/{}"),
    "furbooru": ("fb", "https://furbooru.org/images/{}"),
    "tantabus": ("ta", "https://tantabus.ai/images/{}"),
    "furaffinity": ("fa", "https://www.furaffinity.net/view/{}/"),
    "civit-ai": ("ca", "https://civitai.com/images/{}"),
}
# site -> name prefix; ids are user#post or user#post#photo.
COMPOSITE_SITES = {"twitter": "tx-", "deviantart": "da-", "deviant-art": "da-", "telegram": "te-"}
TWITTER_PATTERN = r"https?://(?:x|twitter)\.com/([^/]+)/status/(\d+)(?:/photo/(\d+))?"
DEVIANTART_PATTERN = r"https?://(?:www\.)?deviantart\.com/([^/]+)/art/.*-(\d+)/?$"
TELEGRAM_PATTERN = r"https://t\.me/([^/]+)/(\d+)$"
# Name stem of an item that has no main origin.
ITEM_STEM = "mlid"

# --- tasks (fixed values) ---
AWAITING, DONE, ERROR, PROCESSING, DISCARDED = 0, 1, 2, 3, 4
STATUS_LABELS = {
    AWAITING: "Wait for processing…",
    DONE: "Done!",
    ERROR: "ERROR!!!",
    PROCESSING: "Processing…",
    DISCARDED: "Discarded",
}
MEDIA_TYPES = ("image", "audio", "video")

# --- listing (fixed values) ---
PAGE_SIZE, PAGE_MIN, PAGE_MAX = 24, 3, 1000
ALBUM_PAGE_SIZE = 20
SIMILAR_LIMIT = 50
PRESETS = ("bypass", "basic", "safe", "aesthetic")
OPEN_PRESETS = ("safe", "aesthetic")
