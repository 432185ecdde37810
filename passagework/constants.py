"""Fixed values.

Everything in this module is a fixed value: a threshold, word list, pattern or reply text that has to be
exactly this for results to come out right.  Logic lives elsewhere.
"""

# --- page quality -----------------------------------------------------------------------------------
TEXT_PAGE_MIN_CHARS = 40
DOCUMENT_MIN_CHARS = 100
MIN_TEXT_PAGE_RATIO = 0.05

# --- page furniture and page types ------------------------------------------------------------------
EDGE_LINES = 8
FURNITURE_PAGE_RATIO = 0.5
FURNITURE_MIN_PAGES = 4
FURNITURE_MAX_LINE = 250
TOC_LINE_RATIO = 0.30
TOC_MIN_LINES = 8
SKIPPED_PAGE_TYPES = ("copyright", "table_of_contents")
COPYRIGHT_PHRASES = (
    "creative commons",
    "copyright",
    "some rights reserved",
    "sales, rights and licensing",
    "third-party materials",
    "general disclaimers",
)
TOC_WORDS = ("contents", "acknowledgements", "abbreviations", "figures", "tables")
PROTECTED_LINE = r"^[0-9]+(\.[0-9]+)+$"
PAGE_NUMBER_LINE = r"(?i)^([0-9]{1,4}|page\s+[0-9]+(\s+of(\s+[0-9]+)?)?|[0-9]+\s+of\s+[0-9]+)$"
TOC_LINE = r"(\s[0-9]{1,3}$)|(^[0-9]{1,3}$)"

# --- sections and chunks ----------------------------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
MIN_CHUNK_CHARS = 60
MIN_SECTION_CHARS = 30
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", " ")
LOCATE_PROBE = 40
LOCATE_PROBE_MIN = 20
NUMBERED_HEADING = r"^[0-9]+(\.[0-9]+)*[ \t]+[A-Z][^\n]{2,80}$"
ANNEX_HEADING = r"^Annex\s+[0-9]+\s*:[^\n]{0,40}$"
WRAPPED_LINE = (2, 40)
PLAIN_HEADING = r"^[A-Z][A-Za-z ,\-]{3,70}$"
HEADING_BOILERPLATE = (
    r"(^[0-9]+\s*(of)?\s*[0-9]*$)|(^(?i:page)\s+[0-9]+)|©|(?i:all rights reserved)|(?i:notice of rights)"
)
PREAMBLE = "Preamble"
GENERAL = "General"

# --- provenance defaults ----------------------------------------------------------------------------
UNKNOWN_TITLE = "UNKNOWN — add this file to SOURCE_METADATA"
UNKNOWN_PUBLISHER = "UNKNOWN"
UNKNOWN_DOCUMENT = "Unknown document"
DEFAULT_LABEL = "Verified clinic document"

# --- uploads ----------------------------------------------------------------------------------------
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
PDF_SIGNATURE = "%PDF-"
PDF_SIGNATURE_WINDOW = 1024
INSUFFICIENT_TEXT = "insufficient_text"
SCANNED_MESSAGE = (
    "This PDF appears to contain scanned, image-only pages with no extractable text. "
    "Upload a searchable PDF instead."
)
SHORT_MESSAGE = "The PDF did not contain enough searchable text to build a reliable index."
LOW_TEXT_WARNING = "Less than half of the PDF pages contain searchable text"

# --- retrieval --------------------------------------------------------------------------------------
TOP_K = 10
RETRIEVAL_K = 5
DOCTOR_RETRIEVAL_K = 8
RERANK_CANDIDATES = 30
RRF_K = 8
DISTANCE_GATE = 1.65
DOCTOR_DISTANCE_GATE = 1.80
ABSTAIN_ABOVE = 0.75
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RECALL_AT = (1, 3, 5, 10)

# --- chunk report -----------------------------------------------------------------------------------
SMALL_CHUNK = 100
VERY_SMALL_CHUNK = 50
LARGE_CHUNK = 1200
REQUIRED_CHUNK_FIELDS = (
    "chunk_id", "source", "page_number", "section_title", "text", "title", "publisher", "url", "topic",
)
CHUNK_BOILERPLATE = r"(?i)©|all rights reserved|notice of rights|\.{4,}|page [0-9]+ of [0-9]+"

# --- answers and citations --------------------------------------------------------------------------
EXCERPT_MIN, EXCERPT_MAX, CLAIM_MAX = 8, 600, 1200
QUOTE_MAX = 420
RESCUE_MIN, RESCUE_MAX = 24, 600
RESCUE_PREFIX = "The verified guideline states: "
QUOTE_PREFIX = "The clinic's uploaded guidance states: "
FURTHER_PENALTY = 2.0
UNSCORED = -1000.0
DASHES = "‐‑‒–—−"
SINGLE_QUOTES = "‘’‚′"
DOUBLE_QUOTES = "“”„″"
SPACES = "\u00a0\u2007\u202f"
STOP_WORDS = (
    "about", "after", "before", "does", "from", "have", "into", "should",
    "that", "the", "this", "what", "when", "which", "with", "would",
)
ESCALATION = r"(?i)\b(?:further|add(?:ing)?|escalat(?:e|ion)|intensif(?:y|ication)|next)\b"
FURTHER_MEDICINES = r"(?i)\bfurther medicines?\b"
DROPPED_TEXT_NOTE = (
    "Some generated statements could not be matched to exact source text and were excluded."
)
DROPPED_VERDICT_NOTE = (
    "Some generated statements did not pass independent evidence verification and were excluded."
)
SAFETY_NOTICE = (
    "This answer summarizes the clinic's verified sources. It supports, but does not replace, clinical judgment or an "
    "in-person assessment."
)
DEFAULT_MISSING = "A clinic-approved source that directly and specifically supports the requested answer."
PERSONAL_REASONS = ("patient_specific_diagnosis", "patient_specific_dosage_or_treatment")
DEPENDENCY_FAILURES = (
    "retrieval_unavailable",
    "generation_unavailable",
    "generation_rate_limited",
    "evidence_verifier_disabled",
    "evidence_verification_unavailable",
    "evidence_verification_rate_limited",
)
RATE_LIMIT_TYPES = ("RateLimitError", "TooManyRequests")
DOSAGE_QUESTION_ID = 105

# --- message routing --------------------------------------------------------------------------------
GREETINGS = {
    "hello": (
        "hi", "hello", "hey", "hii", "hiii", "helo",
        "good morning", "good afternoon", "good evening", "good night",
        "assalamu alaikum", "salam", "marhaba", "ahlan",
        "yo", "howdy", "hiya",
    ),
    "thanks": (
        "thanks", "thank you", "thank u", "thx", "ty",
        "shukran", "jazakallah",
        "much appreciated", "appreciate it",
    ),
    "farewell": (
        "bye", "goodbye", "good bye", "see you", "see ya",
        "take care", "later", "cya",
        "ma salama", "fi aman allah",
    ),
}
RESCHEDULE = r"(?i)\b(reschedule|rebook|move|change)\b.{0,40}\b(appointment|visit|booking|slot)\b|\breschedule\b"
CANCEL = r"(?i)\b(cancel|remove)\b.{0,40}\b(appointment|visit|booking)\b|\bcancel\b"
BOOK = r"(?i)\b(book|schedule|make)\b.{0,40}\b(appointment|visit|slot)\b|\bbook\b"
AVAILABILITY = (
    r"(?i)\b(available\s+doctors?|doctor\s+availability|which\s+doctors?|"
    r"who\s+(?:is|are)\s+available|who\s+can\s+i\s+see|available\s+now)\b"
)
APPOINTMENT = r"(?i)\b(appointment|appointments|upcoming\s+visit|my\s+visit)\b"
PERSONAL_DIAGNOSIS = (
    r"(?i)\b(?:do i have|what do i have|what(?:'s| is) wrong with me|diagnose me|"
    r"my diagnosis|diagnosis for me|is this (?:a|an)|are these symptoms|what condition do i)\b"
)
PERSONAL_DOSAGE = (
    r"(?i)\b(?:what|which|how (?:much|many|often)|should|can|may)\b.{0,45}"
    r"\b(?:i|me|my)\b.{0,45}\b(?:dose|dosage|take|tablet|pill|medicine|medication|"
    r"increase|decrease|start|stop|change)\b|"
    r"\b(?:increase|decrease|start|stop|change)\b.{0,30}\bmy\b.{0,20}"
    r"\b(?:dose|medicine|medication|treatment)\b|"
    r"\b(?:dose|dosage|prescribe|prescription|treat)\b.{0,80}\b(?:my patient|for me|i should|i)\b"
)
OFF_TOPIC = (
    r"(?i)\b(?:car|toyota|vehicle|oil\s+filter|engine|tyre|tire|recipe|pizza|"
    r"weather|football|movie|music|bitcoin|cryptocurrency|programming|code|"
    r"wifi|password|capital\s+of|holiday|flight)\b"
)

# --- reply texts (audience, reason, mode or kind) -> text -------------------------------------------
REPLIES = (
    ("patient", "hello",
     "Hello! I can help you check, book, cancel, or reschedule appointments, or see which doctors are available."),
    ("patient", "thanks", "You're welcome! Let me know if there's anything else I can help with."),
    ("patient", "farewell", "Goodbye! Take care, and don't hesitate to reach out if you need anything."),
    ("patient", "book",
     "I can help you book your appointment. Please choose a doctor and available time below, "
     "then confirm your choice."),
    ("patient", "cancel",
     "I can help you cancel your appointment. Please choose an appointment to cancel below, "
     "then confirm your choice."),
    ("patient", "reschedule",
     "I can help you reschedule your appointment. Please choose an appointment and a new available time below, "
     "then confirm your choice."),
    ("patient", "patient_medical_not_supported",
     "I'm sorry, but I can't answer medical questions. Please contact your doctor or the clinic for medical "
     "advice. I can help you check, book, cancel, or reschedule appointments."),
    ("doctor", "non_medical_question",
     "This assistant answers clinical questions only from the clinic's verified uploaded guidance. "
     "Please ask a medical guideline question."),
    ("doctor", "personal",
     "I can summarize the clinic's verified guideline criteria, dosing ranges, contraindications, and "
     "monitoring requirements, but I can't diagnose an individual patient or select their treatment or dose. "
     "Rephrase the question as a general guideline question, then apply the cited guidance using the "
     "patient's complete clinical assessment and your professional judgment."),
    ("patient", "personal_triage",
     "I can't diagnose you or choose a dose or treatment for your individual case. If your symptoms are severe, "
     "getting worse, or worrying you, seek urgent in-person or emergency care now. Otherwise, contact the clinic "
     "for a clinician who can assess your history safely."),
    ("patient", "personal_general",
     "I can summarize general information from the clinic's verified guidance, but I can't diagnose you or "
     "recommend a dose or treatment for your individual case. Please ask your doctor or the clinic, because they "
     "can consider your examination, medical history, medicines, and test results."),
    ("doctor", "insufficient",
     "The clinic's verified guidance retrieved for this question does not establish a single guideline-backed "
     "answer. No clinical recommendation is being displayed. Review the cited guideline context and apply your "
     "professional judgment."),
    ("patient", "insufficient_general",
     "I don't have information about that in the documents this clinic has uploaded, so I can't answer it "
     "reliably. Please contact the clinic directly, or speak to your doctor."),
    ("patient", "insufficient_triage",
     "I don't have guidance about that in this clinic's documents. If your symptoms are severe, getting worse, "
     "or worrying you, please seek urgent in-person or emergency care now rather than waiting. Otherwise, contact "
     "the clinic to speak to your doctor."),
    ("any", "rate_limited",
     "The clinic's assistant is handling too many questions right now. Please wait a moment and ask again."),
    ("any", "unavailable",
     "I can't access the clinic's knowledge system right now, so I can't give a reliable answer. Please try again "
     "shortly or contact the clinic directly."),
)

# --- scheduling -------------------------------------------------------------------------------------
SLOT_MINUTES = 30
HORIZON_DAYS = 14
SENTINEL_CLINIC = "00000000-0000-0000-0000-000000000000"
