"""Values that results depend on: weights, limits, word lists, presets. All are fixed values."""

from __future__ import annotations

# Windows and candidates.
WINDOW_SECONDS, WINDOW_STEP = 45, 30
MIN_CANDIDATE_SCORE = 62
OVERLAP_LIMIT = 0.72
MAX_CANDIDATES = 8

# Weights in hundredths.
CANDIDATE_WEIGHTS = {"hook": 24, "curiosity": 18, "emotion": 12, "story": 14, "payoff_potential": 14, "standalone": 10, "information_density": 8}
RETENTION_WEIGHTS = {"hook": 22, "curiosity": 15, "emotion": 10, "conflict": 8, "payoff": 17, "information_density": 11, "pacing": 12, "standalone": 5}
HOOK_WEIGHTS = {"curiosity": 18, "stakes": 12, "surprise": 12, "clarity": 13, "relevance": 16, "brevity": 10, "naturalness": 7, "specificity": 5, "emotional_impact": 3, "fit": 4}
HOOK_DEFAULTS = {"curiosity": 50, "stakes": 50, "surprise": 50, "clarity": 70, "relevance": 70, "naturalness": 70, "specificity": 60, "emotional_impact": 50, "fit": 70}

# Context and edits.
CONTEXT_BEFORE, CONTEXT_AFTER, CONTEXT_CHARS = 45.0, 20.0, 16000
SNAP_SECONDS, MIN_SEGMENT, MERGE_GAP = 0.85, 0.35, 0.08
MAX_VARIANTS, MAX_SEGMENTS = 3, 8
MIN_CLIP, MAX_CLIP = 12.0, 60.0
ROLES = ["hook", "context", "escalation", "payoff", "bridge", "reaction"]
BUCKET_SECONDS = 5.0

# Hooks.
WEAK_PREFIXES = [
    "știai că", "stiai ca", "în acest videoclip", "in acest videoclip", "astăzi vom vorbi", "astazi vom vorbi", "uite un clip",
    "uită-te până la final", "uita-te pana la final", "nu o să-ți vină să crezi", "nu o sa-ti vina sa crezi",
    "did you know", "in this video", "watch until the end", "you won't believe",
]
RO_HINTS = ["și", "să", "este", "care", "pentru", "de ce", "acest", "asta", "după", "pierde", "câștigă", "greșeala", "nimeni", "momentul", "totul"]
EN_HINTS = ["the", "and", "why", "how", "this", "that", "what", "after", "before", "lost", "won", "mistake", "nobody", "moment", "everything"]
VOICE_MAX_WORDS, VOICE_MIN_SCORE, VOICE_SECONDS, VOICE_FADE = 20, 60, 4.0, 0.20

# Pacing.
FILLERS = [
    "ă", "aaa", "ăă", "ăăă", "mmm", "hmm", "gen", "practic", "deci", "cumva", "adică", "efectiv", "literalmente", "știi", "stii", "păi", "pai",
    "uh", "um", "erm", "like", "basically", "literally", "actually", "you know", "i mean", "kind of", "sort of",
]

# Caption grouping.
STARTERS = ["și", "iar", "dar", "că", "ca", "de", "la", "în", "pe", "cu", "din", "spre", "pentru", "să", "sa", "se", "ori", "to", "of", "the", "a", "an", "and", "or", "but", "for", "in", "on", "at", "with"]
ENDERS = ["și", "iar", "dar", "că", "ca", "de", "la", "în", "pe", "cu", "din", "spre", "pentru", "să", "sa", "to", "of", "the", "a", "an", "and", "or", "but", "for", "in", "on", "at", "with"]
PHRASES = [
    "nu știu", "nu vreau", "nu pot", "nu mai", "nu cred", "nu este", "nu e", "ce faci", "ce este", "ce spui", "ce înseamnă", "hai să", "trebuie să",
    "vreau să", "poți să", "pot să", "de fapt", "de exemplu", "de aceea", "de ce", "în general", "în schimb", "în primul rând", "în cele din urmă",
    "o să", "am fost", "a fost", "au fost", "you know", "i think", "i know", "i want", "have to", "going to", "kind of", "sort of", "thank you",
]
UNITS = [
    "secundă", "secunde", "minute", "minut", "oră", "ore", "zi", "zile", "săptămână", "săptămâni", "lună", "luni", "an", "ani", "lei", "euro", "dolari", "%", "procente",
    "second", "seconds", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
]

# Caption styles; the fields in order, then those of each preset that differ from the base.
STYLE_FIELDS = ["font", "font_size", "primary_color", "secondary_color", "outline_color", "back_color", "bold", "italic", "outline", "shadow", "alignment", "margin_v", "margin_l", "margin_r", "scale_x", "scale_y", "spacing", "angle", "border_style", "encoding"]
STYLE_BASE = {
    "font": "Anton", "font_size": 94, "primary_color": "&H00FFFFFF", "secondary_color": "&H0000FFFF", "outline_color": "&H00000000", "back_color": "&H50000000",
    "bold": -1, "italic": 0, "outline": 5, "shadow": 2, "alignment": 2, "margin_v": 145, "margin_l": 70, "margin_r": 70,
    "scale_x": 100, "scale_y": 100, "spacing": 0, "angle": 0, "border_style": 1, "encoding": 1,
}
STYLES = {
    "modern": {},
    "tiktok": {},
    "reels": {"font_size": 90, "back_color": "&H40000000", "outline": 4, "shadow": 1, "margin_v": 150, "margin_l": 75, "margin_r": 75},
    "capcut": {"font_size": 92, "outline": 4, "shadow": 1, "margin_v": 140, "margin_l": 80, "margin_r": 80},
    "submagic": {"font_size": 96, "margin_v": 150},
    "minimal": {"font": "Montserrat", "font_size": 72, "secondary_color": "&H00FFFFFF", "back_color": "&H00000000", "bold": 0, "outline": 2, "shadow": 0, "margin_v": 120, "margin_l": 60, "margin_r": 60},
}
STYLE_OVERRIDES = {"font": "Anton", "font_size": 92, "primary_color": "&H00FFFFFF", "secondary_color": "&H0000FFFF", "outline_color": "&H00000000", "back_color": "&H64000000", "outline": 4, "shadow": 1, "alignment": 2, "margin_v": 140}

# Animation tags for a whole line and for the active word.
LINE_TAGS = {"none": "", "fade": r"{\fad(70,70)}", "pop": r"{\fad(35,35)}", "zoom": r"{\fad(35,35)}", "bounce": r"{\fad(30,30)}", "capcut": r"{\fad(30,30)}", "submagic": r"{\fad(20,20)}"}
WORD_TAGS = {
    "none": "",
    "fade": r"{\fad(20,20)}",
    "pop": r"{\fscx90\fscy90\t(0,65,\fscx116\fscy116)\t(65,135,\fscx100\fscy100)}",
    "zoom": r"{\fscx92\fscy92\t(0,90,\fscx112\fscy112)\t(90,180,\fscx100\fscy100)}",
    "bounce": r"{\fscx88\fscy88\t(0,60,\fscx118\fscy118)\t(60,115,\fscx97\fscy97)\t(115,180,\fscx100\fscy100)}",
    "capcut": r"{\fscx90\fscy90\t(0,55,\fscx114\fscy114)\t(55,120,\fscx100\fscy100)}",
    "submagic": r"{\fscx88\fscy88\t(0,50,\fscx117\fscy117)\t(50,105,\fscx102\fscy102)\t(105,160,\fscx100\fscy100)}",
}
RESET_TAG = r"{\fscx100\fscy100}"
PLAIN_COLOR, ACTIVE_COLOR = "&H00FFFFFF", "&H0000FFFF"

# Voices by language code.
VOICE_CODES = {"en": "a", "en-us": "a", "en_us": "a", "en-gb": "b", "en_gb": "b", "es": "e", "fr": "f", "fr-fr": "f", "hi": "h", "it": "i", "pt": "p", "pt-br": "p", "pt_br": "p", "ja": "j", "jp": "j", "zh": "z", "zh-cn": "z"}
VOICES = {"a": "af_heart", "b": "bf_emma", "e": "ef_dora", "f": "ff_siwis", "h": "hf_alpha", "i": "if_sara", "p": "pf_dora", "j": "jf_alpha", "z": "zf_xiaobei"}
VOICE_PROVIDER, VOICE_FALLBACK, VOICE_LANGUAGE = "kokoro", "windows_sapi", "en"

# Crop tracking.
CROP_RATIO = 9 / 16
SMOOTHING, DEAD_ZONE, MAX_MOVE = 0.32, 0.07, 0.18
