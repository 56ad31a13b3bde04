"""Fixed values.

Every word list, lookup table, pattern and constant below has to equal the
published behaviour for results to agree, so they are stated as plain text.
"""

# Document states and catalogue domain.
DOCUMENT_STATUSES = ["READY", "PENDING", "FAILED", "INDEXED"]

CANONICAL_SOURCE_TYPES = [
    "byu_speeches_es",
    "byu_speeches_en",
    "discursos_sud",
    "general_conference",
    "church_manuals",
    "joseph_smith_papers",
    "byu_rsc",
    "scriptures",
]

SOURCE_LABELS = {
    "byu_speeches_es": "BYU Speeches ES",
    "byu_speeches_en": "BYU Speeches EN",
    "discursos_sud": "Discursos SUD",
    "general_conference": "Conferencia General",
    "church_manuals": "Manuales de la Iglesia",
    "joseph_smith_papers": "Joseph Smith Papers",
    "byu_rsc": "BYU Religious Studies Center",
    "scriptures": "Escrituras",
}

SOURCE_ALIASES = {
    "byu_speeches_es": ["byu_speeches_es", "byu_speeches_spanish", "speeches_byu_es"],
    "byu_speeches_en": ["byu_speeches_en", "byu_speeches", "speeches_byu", "byu"],
    "discursos_sud": ["discursos_sud", "discurso_sud", "discursosud"],
    "general_conference": ["general_conference", "conference", "conferencia_general", "general-conference"],
    "church_manuals": [
        "church_manuals", "manuals", "manuales", "church_manual", "come_follow_me", "teachings_presidents",
    ],
    "joseph_smith_papers": ["joseph_smith_papers", "jsp", "josephsmithpapers"],
    "byu_rsc": ["byu_rsc", "rsc", "religious_studies_center"],
    "scriptures": ["scriptures", "scripture", "escrituras"],
}

LEGACY_SOURCE_TYPES = {
    "byu_speeches": "byu_speeches_en",
    "discursosud": "discursos_sud",
    "churchofjesuschrist": "churchofjesuschrist",
    "josephsmithpapers": "joseph_smith_papers",
}

LEGACY_REPLACEMENTS = {
    "byu_speeches_en": "byu_speeches",
    "discursosud": "discursos_sud",
    "josephsmithpapers": "joseph_smith_papers",
    "churchofjesuschrist": None,
}

TRUSTED_SOURCE_KEYS = ["churchofjesuschrist", "josephsmithpapers"]

# Duplicate detection.
EMPTY_TEXT_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
MEDIA_QUERY_KEYS = ["imageview", "download", "asset", "media"]
REVISION_TERMS = ["edition", "revised", "revision", "updated", "version"]
OFFICIAL_HOST_SUFFIXES = ["churchofjesuschrist.org", "byu.edu", "josephsmithpapers.org"]
CLASS_PRIORITY = {
    "exact_duplicate": 60,
    "translation": 50,
    "revised_edition": 40,
    "related_media": 30,
    "probable_duplicate": 20,
    "not_duplicate": 10,
}
HIDDEN_CLASSES = ["exact_duplicate", "probable_duplicate"]
URL_LANGUAGE_ALIASES = {"eng": "en", "spa": "es", "por": "pt", "fra": "fr", "deu": "de"}

# URL hygiene.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
CURATED_TRACKING_KEYS = [
    "fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
]
CURATED_HOSTS = {
    "discursosud.com": "discursos_sud_es",
    "www.discursosud.com": "discursos_sud_es",
    "speeches.byu.edu": "byu_speeches_es",
    "www.speeches.byu.edu": "byu_speeches_es",
    "churchofjesuschrist.org": "church_official_es",
    "www.churchofjesuschrist.org": "church_official_es",
}
CURATED_NAVIGATION = ["author", "category", "page", "search", "tag"]

# Scripture references.
SCRIPTURE_BOOKS = {
    "1 nephi": "1 Nephi",
    "2 nephi": "2 Nephi",
    "3 nephi": "3 Nephi",
    "alma": "Alma",
    "mosiah": "Mosiah",
    "moroni": "Moroni",
    "doctrine and covenants": "Doctrine and Covenants",
    "d&c": "Doctrine and Covenants",
    "dyc": "Doctrine and Covenants",
    "mateo": "Matthew",
    "matthew": "Matthew",
    "john": "John",
    "juan": "John",
    "romans": "Romans",
    "romanos": "Romans",
}
SCRIPTURE_PATTERN = (
    r"\b(1\s*Nephi|2\s*Nephi|3\s*Nephi|Alma|Mosiah|Moroni|Doctrine and Covenants|D&C|DyC|Mateo|Matthew"
    r"|John|Juan|Romans|Romanos)\s+(\d{1,3}):(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?\b"
)
CURATED_SCRIPTURE_PATTERN = (
    r"\b(?:1|2|3)?\s?(?:Nephi|Alma|Mosiah|Moroni|Matthew|John|Romans)\s+\d{1,3}:\d{1,3}(?:-\d{1,3})?\b"
    r"|\b(?:Doctrine and Covenants|D&C)\s+\d{1,3}:\d{1,3}(?:-\d{1,3})?\b"
)

# Spanish content gate.
SPANISH_MARKERS = [
    "al", "como", "con", "cristo", "de", "del", "dios", "el", "en", "es", "evangelio", "jesucristo",
    "la", "las", "los", "para", "por", "que", "se", "su", "una", "y",
]
ENGLISH_MARKERS = [
    "and", "are", "christ", "come", "for", "from", "god", "is", "jesus", "of", "that", "the", "this",
    "to", "was", "with", "you",
]
WORKFLOW_ENGLISH_MARKERS = [
    "and", "are", "christ", "for", "from", "god", "is", "jesus", "of", "that", "the", "this", "to",
    "was", "with", "you",
]
WORD_PATTERN = "[a-záéíóúüñ]+"
NON_SPANISH_CODES = ["de", "deu", "en", "eng", "fr", "fra", "it", "ita", "por", "pt"]
PLACEHOLDERS = [
    "[reemplazar antes de enviar]",
    "contenido de prueba",
    "documento de prueba",
    "no es una cita oficial",
    "no reemplaza ninguna fuente doctrinal",
    "placeholder",
]
CLEANUP_PLACEHOLDERS = [
    "[reemplazar antes de enviar]",
    "no es una cita oficial",
    "no reemplaza ninguna fuente doctrinal",
    "contenido de prueba",
    "placeholder",
]
RAW_HTML_TAGS = ["<html", "<body", "<script", "<style", "<nav", "<header", "<footer"]
HTML_TAG_PATTERN = r"</?[a-zA-Z][^>]*>"
NAVIGATION_WORDS = r"\b(inicio|menu|buscar|compartir|suscribete|cookies?|privacidad|siguiente|anterior)\b"
NAVIGATION_LINES = (
    r"^(inicio|menu|buscar|compartir|descargar|siguiente|anterior|todos los derechos|privacy|cookies?)\b"
)
TAG_TRANSLATIONS = {
    "atonement": "Expiación",
    "book of mormon": "Libro de Mormón",
    "covenants": "Convenios",
    "faith": "Fe",
    "gospel": "Evangelio",
    "holy ghost": "Espíritu Santo",
    "jesus christ": "Jesucristo",
    "prayer": "Oración",
    "repentance": "Arrepentimiento",
    "temple": "Templo",
}

# Search terms.
SEARCH_STOPWORDS = [
    "about", "como", "cual", "desde", "does", "from", "mention", "mentions", "para", "pero", "por",
    "que", "sources", "sobre", "teach", "that", "the", "una", "what", "where", "with",
]
TALK_STOPWORDS = [
    "para", "sobre", "con", "una", "unos", "las", "los", "del", "que", "the", "and", "about",
]
STUDY_STOPWORDS = [
    "con", "para", "por", "que", "los", "las", "una", "del", "como", "este", "esta",
]
MATCH_WEIGHTS = {
    "title": 5, "author": 3, "source": 2, "description": 2, "text": 1, "tags": 2, "chunk": 2,
}
LEADERSHIP_TERMS = [
    "primera presidencia",
    "first presidency",
    "cuorum de los doce",
    "cuórum de los doce",
    "quorum of the twelve",
    "apostoles actuales",
    "apóstoles actuales",
    "liderazgo vigente",
    "current leadership",
    "presidente actual",
    "current president",
]

# Fetch and asset checks.
BLOCK_PHRASES = [
    "cloudflare", "attention required", "checking your browser", "access denied", "temporarily blocked",
    "captcha", "verify you are human",
]
BLOCK_STATUSES = [403, 429, 503]
BLOCK_SCAN_CHARS = 8000
NON_HTML_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".zip", ".mp4", ".mov"]

# Metadata repair.
BAD_TITLE_PREFIXES = [
    "the text for this speech is unavailable",
    "pretendemos modificar a tradução",
    "tenemos la intención de modificar",
    "nous sommes toujours prêts",
]
GENERIC_SLUGS = ["about", "all", "archive", "home", "index", "search", "speeches", "study", "talks"]

# Privacy.
SECRET_KEYS = [
    "api_key", "apikey", "authorization", "cookie", "openai_api_key", "password", "password_hash",
    "qdrant_api_key", "refresh_token", "secret", "secret_access_key", "token",
]
INLINE_SECRETS = ["authorization:", "bearer ", "api_key=", "password=", "secret="]
INLINE_KEY_PATTERN = r"\bsk-[A-Za-z0-9_-]+"
SENSITIVE_TERMS = [
    "api_key", "authorization", "cookie", "database_url", "password", "secret", "service_role", "token",
]
INGEST_SENSITIVE_KEYS = [
    "api_key", "authorization", "cookie", "database_url", "ingestion_api_key", "password", "secret", "token",
]

# Study material.
BLOCK_TYPES = ["personal_note", "post_it", "scripture", "quote", "reflection", "doctrinal_analysis"]
BLOCK_TYPE_ALIASES = {
    "ai_quote": "quote",
    "manual_reference": "quote",
    "ai_doctrinal_analysis": "doctrinal_analysis",
    "reflection_question": "reflection",
}
OUTLINE_TITLES = [
    "Introduccion: {topic}",
    "Principio doctrinal",
    "Aplicacion personal",
    "Testimonio y llamado a actuar",
    "Cierre con convenio",
]
OUTLINE_PURPOSES = [
    "Abrir el tema de forma relevante para {audience}.",
    "Establecer el fundamento doctrinal con fuentes verificables.",
    "Mostrar como vivir el principio en decisiones cotidianas.",
    "Cerrar con testimonio, invitacion y esperanza.",
    "Conectar la aplicacion con convenios y discipulado continuo.",
]

# Damaged UTF-8 and its repair.  Order matters.
DAMAGE_MARKERS = ["Ã", "Â", "â€", "â€™", "â€œ", "â€\x9d", "â€“", "â€”", "ï¿½", "�"]
TRUNCATED_SEQUENCES = {
    "Ãƒltimos": "Últimos",
    "Ãƒl": "Él",
    "Ãltimos": "Últimos",
    "Ãl": "Él",
}
SEQUENCE_REPAIRS = {
    "Ãƒl": "Él",
    "Ãƒltimos": "Últimos",
    "Ãl": "Él",
    "Ãltimos": "Últimos",
    "â€œ": "“",
    "â€\x9d": "”",
    "â€˜": "‘",
    "â€™": "’",
    "â€“": "–",
    "â€”": "—",
    "â€¦": "…",
    "â€¢": "•",
    "Â¿": "¿",
    "Â¡": "¡",
    "Â«": "«",
    "Â»": "»",
    "ÃƒÂºltimos": "últimos",
    "DÃƒÂ\xadas": "Días",
    "SeÃƒÂ±or": "Señor",
    "EspÃƒÂ\xadritu": "Espíritu",
    "reflexiÃƒÂ³n": "reflexión",
}
IDENTIFIER_KEYS = [
    "api_key", "authorization", "canonical_url", "content_hash", "cookie", "database_url", "document_id",
    "email", "file_url", "hash", "id", "key", "normalized_url", "password", "secret", "slug", "source_url",
    "storage_path", "token", "url", "uri",
]
