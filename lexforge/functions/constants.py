"""Values that results depend on. They are fixed: each stands here as text, in one place, and is used by name elsewhere."""

# Words that retrieval leaves out.
STOP_WORDS = """
a an and are as at be been being but by can could did do does for from had has have he her hers him his how i if in into is it
its itself me might more most my of on or our ours she should so some than that the their theirs them then there these they this
those to was we were what when where which who why will with would you your yours
""".split()
# Fixed value: summaries keep this one.
SUMMARY_STOP_WORDS = [w for w in STOP_WORDS if w != "but"]

# A word, with one inner apostrophe or hyphen; the break between sentences; what is trimmed from one.
WORD = "[\\p{L}\\p{N}]+(?:['’\\-][\\p{L}\\p{N}]+)?"
PLAIN_WORD = "[\\p{L}\\p{N}]+"
SENTENCE_BREAK = "(?U)(?<=[.!?])\\s+|\\n{2,}"
SENTENCE_TRIM = " \t\r\n-•"
QUESTION_STARTS = ["What ", "How ", "Why ", "Investigate "]

# Words that tell languages, in the order that settles ties.
LANGUAGE_WORDS = {
    "en": "the and of to is in for with".split(),
    "cs": "a je se na pro že z v k".split(),
    "de": "der die das und ist von mit für".split(),
    "fr": "le la les des et est dans pour".split(),
    "es": "el la los las y es de para".split(),
}

# Textual media types.
TEXTUAL_TYPES = """
application/ecmascript application/graphql application/javascript application/json application/ld+json application/sql application/toml
application/xml application/xhtml+xml application/x-httpd-php application/x-javascript application/x-sh application/x-yaml application/yaml
text/css text/csv text/event-stream text/javascript text/markdown text/plain text/xml text/yaml
""".split()
# File names' endings, by what they hold.
TEXTUAL_ENDINGS = """
.bash .bat .c .cc .cfg .conf .cpp .cs .css .csv .dart .dockerfile .go .gradle .graphql .h .hpp .htm .html .ini .ipynb .java .jl .js .json
.jsx .kt .kts .less .lua .m .md .php .pl .pm .ps1 .py .r .rb .rmd .rproj .rs .sass .scala .scss .sh .sql .svelte .swift .tcl .tex .toml
.ts .tsv .tsx .txt .vim .vue .xml .yaml .yml
""".split()
CODE_ENDINGS = """
.bash .bat .c .cc .cpp .cs .css .dart .dockerfile .go .gradle .h .hpp .htm .html .java .jl .js .jsx .kt .kts .less .lua .m .makefile .mk
.php .pl .pm .ps1 .psm1 .py .r .rb .rmd .rproj .rs .sass .scala .scss .sh .sol .sql .svelte .swift .tcl .tex .ts .tsx .vim .vue .zig
""".split()
DATA_ENDINGS = ".csv .graphql .ini .json .md .toml .tsv .txt .xml .yaml .yml".split()
NOTEBOOK_ENDINGS = [".ipynb"]
ASSET_ENDINGS = ".gif .ico .jpeg .jpg .png .svg .webp".split()
GENERATED_NAMES = """
.ds_store .editorconfig .gitattributes .gitignore .nojekyll .npmignore .nvmrc .prettierrc .travis.yml cargo.lock composer.lock
desktop.ini gemfile.lock package-lock.json pnpm-lock.yaml poetry.lock thumbs.db yarn.lock
""".split()

# Query parameters that only track, and the hosts and paths that hold code.
TRACKING = "fbclid gclid mc_cid mc_eid msclkid msockid ref ref_ utm_campaign utm_content utm_medium utm_source utm_term".split()
CODE_HOSTS = ["github.com", "raw.githubusercontent.com", "gitlab.com", "bitbucket.org", "archive.softwareheritage.org", "sourceforge.net"]
CODE_MARKERS = ["/blob/", "/raw/", "/-/blob/", "/browse/content/", "/api/1/content/"]
CODE_KINDS = ["code", "source", "notebook"]
LOW_KINDS = ["asset", "generated", "archive_index"]
TREE_HOSTS = ["archive.softwareheritage.org", "www.archive.softwareheritage.org"]

# Topics, their words and weights.
TOPICS = {
    "history": {"history": 3, "historical": 2, "empire": 2, "ancient": 2, "century": 1, "war": 1, "genocide": 3, "revolution": 2},
    "war_and_conflict": {"war": 3, "battle": 2, "military": 2, "conflict": 2, "invasion": 2, "army": 1, "terrorism": 2, "ceasefire": 2},
    "science": {"science": 3, "research": 2, "experiment": 2, "physics": 2, "chemistry": 2, "biology": 2, "astronomy": 2, "mathematics": 2},
    "technology": {"technology": 3, "software": 2, "computer": 2, "programming": 2, "algorithm": 2, "database": 2, "internet": 1, "artificial intelligence": 3},
    "health": {"health": 3, "medical": 2, "medicine": 2, "disease": 2, "patient": 1, "clinical": 2, "treatment": 2, "diagnosis": 2},
    "politics": {"politics": 3, "government": 2, "election": 2, "president": 2, "parliament": 2, "democracy": 2, "party": 1, "policy": 1},
    "law": {"law": 2, "legal": 2, "court": 2, "legislation": 2, "regulation": 2, "constitution": 2, "rights": 1, "treaty": 2},
    "economics": {"economy": 3, "economic": 3, "business": 2, "market": 2, "finance": 2, "company": 1, "trade": 2, "inflation": 2},
    "environment": {"environment": 3, "climate": 3, "ecology": 2, "pollution": 2, "biodiversity": 2, "conservation": 2, "emissions": 2},
    "education": {"education": 3, "school": 2, "university": 2, "student": 1, "teaching": 2, "curriculum": 2, "academic": 1},
    "culture": {"culture": 3, "art": 2, "music": 2, "film": 2, "literature": 2, "language": 1, "museum": 2},
    "sports": {"sport": 3, "football": 2, "soccer": 2, "basketball": 2, "cricket": 2, "tennis": 2, "athlete": 2, "tournament": 2},
}

# Types of documents by what their address, title or first text says, the first that fits.
DOCUMENT_PATTERNS = [
    ("documentation", r"/(docs?|documentation|api)(/|$)|\bapi reference\b"),
    ("academic", r"\b(doi|abstract|peer[- ]review|journal article|methodology)\b"),
    ("news", r"\b(breaking news|newsroom|news article|reported on)\b"),
    ("forum", r"\b(forum|discussion|thread|comments?)\b"),
    ("legal_reference", r"\b(act|statute|regulation|case law|ordinance)\b"),
]

# Signals of where a text comes from.
AI_SIGNALS = [
    ("explicit_ai_generation", r"\b(?:ai|a\.i\.)[- ]?(?:generated|written|created|produced)\b"),
    ("chatgpt_or_openai", r"\b(?:chatgpt|openai|gpt[- ]?[2345])\b"),
    ("other_ai_writer", r"\b(?:claude|gemini|copilot|jasper|llm|large language model)\b"),
    ("synthetic_content", r"\b(?:synthetic|machine[- ]generated)\s+(?:text|content|media)\b"),
]
HUMAN_SIGNALS = [
    ("author_metadata", r"<meta[^>]+(?:name|property)=[\"'][^\"']*author[^\"']*[\"'][^>]+content=|rel=[\"']author[\"']"),
    ("publisher_metadata", r"<meta[^>]+(?:name|property)=[\"'][^\"']*(?:publisher|site_name)[^\"']*[\"'][^>]+content="),
    ("publication_date", r"(?:datepublished|article:published_time|pubdate|published_time|published[-_ ]date)"),
    ("byline_text", r"(?:^|[\r\n])\s*(?:by|written by|reported by|edited by)\s+[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3}"),
]
REASONS = {
    "ai_flagged": "The page contains an AI-generation, AI-tool, or synthetic-content signal.",
    "human_signals": "The page exposes authorship or publication metadata, with no explicit AI-generation disclosure found.",
    "unknown": "No explicit AI disclosure or strong authorship metadata was found. This is not proof of human authorship.",
    "archive_signals": "The page is served from the public Software Heritage archive; the archived content's authorship is not verified.",
}

# seeds' ranking.
LOW_HOSTS = ["facebook.com", "instagram.com", "pinterest.com", "tiktok.com", "twitter.com", "x.com", "youtube.com"]
GOOD_ENDINGS = [".edu", ".gov", ".org"]
GOOD_PATHS = ["article", "research", "paper", "report", "docs", "wiki"]
SEARCH_TRACKING = [t for t in TRACKING if t != "msockid"]

# Site chrome and content in pages.
BLOCK_WORDS_IN_ATTRIBUTES = """
nav menu header footer sidebar cookie modal banner breadcrumb pagination search login cart recommend related share social promo
advert filter wishlist drawer popup
""".split()
CHROME_PARTS = ["cookie-banner", "consent-dialog", "newsletter-form"]
CONTENT_PARTS = "entry-content article-body post-content page-content main-content content-body article-content main".split()
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
ARCHIVE_PAGE_NOISE = [
    r"^raw file download\b.*", r"^cancelok$", r"^cancel$", r"^ok$", r"^×$", r"^(?:branches|releases|visits)(?: \(\d+\))?$",
    r"^no releases to show$", r"^display warning$", r"^formatbibtexcsl json$", r"^copy citation$", r"^copy identifiercopy permalink$",
    r"^generating citation \.\.\.$", r"^take a new snapshot of a software origin$", r"^processing \"take a new snapshot\" request \.\.\.$",
    r"^the requested archive is no longer available.*", r"^download link has expired$", r"^do you want to cook it again \?$",
    r"^invalid email !$", r"^the provided email is not well-formed\.$", r"^iframe embedding$", r"^permalinks$", r"^citations$",
    r"^branch: .*$", r"^refs/heads/.*", r"^visit type.*", r"^code$", r"^loading .* \.\.\.$",
]

# The compact container.
CONTAINER_MAGIC = b"LCA\x01\x00\x00\x00\x00"
SUMMARY_STEPS = [900, 700, 500, 350, 250, 180, 120]
