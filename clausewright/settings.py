"""Fixed values of the analysis: word lists, weights and limits. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

# Markers, in the order in which they are reported.
EXCEPTION_MARKERS = ["notwithstanding", "except as", "except that", "except for", "provided that", "provided, however, that", "shall not apply", "exempt", "exemption", "carve-out", "carveout", "unless"]
OBLIGATION_MARKERS = ["shall not exceed", "shall", "must", "no less than", "at a minimum", "covenants and agrees", "obligated to", "required to"]
DEFINITION_MARKERS = [" means ", " shall mean ", " has the meaning "]
REMEDY_MARKERS = ["sole remedy", "remedy", "cure period", "in the event", "liquidated damages"]
EXEMPTING = ["exempt", "notwithstanding", "shall not apply", "carve-out", "provided that"]
TOPICAL = ["notwithstanding", "exempt", "provided that", "shall not exceed"]
# Words that an assertion is parsed by.
OBLIGATION_WORDS = [
    "violates", "violate", "violation", "exceeds", "exceed", "minimum", "minimums", "threshold", "thresholds", "cap", "breach", "breaches", "default", "prohibited", "restricted", "mandatory",
    "required", "must", "shall", "covenant", "indemnify", "liability", "consent", "notice",
]
INSTRUMENTS = ["term sheet", "agreement", "merger agreement", "spa", "purchase agreement", "side letter", "schedule", "exhibit", "charter", "bylaws"]
STOP_WORDS = ["your", "the", "our", "their", "this", "that", "in", "on", "of", "to", "for", "and", "or", "is", "are", "was", "were", "under", "with", "by", "from", "as", "at", "be", "have", "has"]
QUALIFIERS = r"(?i)\b(q1|q2|q3|q4|first quarter|second quarter|third quarter|fourth quarter|annual|quarterly|monthly|prior|closing|post-closing|\d+%|\$\d+(?:,\d{3})*(?:\s*million|\s*m)?)\b"
# The kinds of expansion with their weights, in order.
KINDS = {"obligation": 1.0, "exception": 1.3, "definition": 0.8, "remedy": 0.8}
# Search, fusion and cards.
RRF_K = 60
TOP_K = 10
CARDS = 3
XREF_DISCOUNT = 0.7
REVERSE_BOOST = 1.03
NUDGE = 0.025
NUDGE_SHARE = 0.72
# The confidence gate.
NO_SPEECH = 0.6
ASR_FLOOR = 0.25
SIM_FLOOR = 0.30
SIM_CEIL = 0.62
MARGIN_CEIL = 0.08
AMBER = 0.55
STANCE_MIN = 0.25
W_ASR = 0.30
W_SNR = 0.15
W_SIM = 0.35
W_MARGIN = 0.20
# Documents.
PAGE_BREAK = "--- PAGE BREAK ---"
PAGE_LINES = 40
SCANNED_CHARS = 100
SCANNED_SHARE = 0.3
HEADER_SHARE = 0.6
SHORT_UNIT = 12
MAX_UNIT = 320
HASHES = r"^#{1,3}\s+"
# Lines that start a block, each with its own rule on case.
HEADINGS = [HASHES, r"(?i)^(?:ARTICLE|SECTION)\s+[IVXLC\d.]+", r"^\d+(?:\.\d+)+(?:\([a-z0-9]+\))?\s+", r"^\([a-z]\)\s+", r'^"[A-Z][\w\s-]+"']
# Audio and speech.
SAMPLE_RATE = 16_000
HANGOVER_MS = 600
MOST_SPEECH_MS = 15_000
LEAST_SPEECH_MS = 250
PARTIAL_MS = 750
