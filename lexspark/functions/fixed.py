"""Patterns, word lists, wordings and limits that decide the results."""

# --- profile: what a question lacks when it has a profile at all ---------------------------------
PROFILE_DEFAULTS = {"state": "All", "income": 500000, "occupation": "General", "category": "General"}
APP_PROFILE = {"state": "All India", "income": 200000, "occupation": "General", "category": "General"}
APP_SCHEME_PROMPT = "Recommend top 3 schemes for {occupation} with income ₹{income} in {state}"
APP_COMPARE_PROMPT = "Explain how {query}"
APP_CONTEXT_SCHEMES = 5

# --- limits (characters, rows) -----------------------------------------------------------------
MIN_DOCUMENT_CHARS = 100
MIN_PAGE_CHARS = 50
MIN_PARAGRAPH_CHARS = 30
MIN_BODY_CHARS = 20
FILES_PER_BATCH = 50
EMBED_BATCH = 10
EMBED_TRIES = 3
ELIGIBLE_ROWS = 10
EVALUATION_CAPS = {"en": 20, "hi": 15}

# --- section text ------------------------------------------------------------------------------
STATUTORY_SECTION = r"(?ms)^(\d+[A-Z]?)\s*\.\s+([^\n]{5,150}?)(?:\.--|\.\s*-|:)\s*(.{20,})"
SIMPLE_SECTION = r"\A(\d+[A-Z]?)\s*\.\s+([^\n]{5,150})"
CHAPTER = r"(?i)CHAPTER\s+([IVX]+[A-Z]?)"
PARAGRAPH_BREAK = r"\n\s*\n"
CAPITALISED_PHRASE = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
UNKNOWN_CHAPTER = "UNKNOWN"

# --- scheme text -------------------------------------------------------------------------------
SCHEME_NAME = r"([A-Z][A-Za-z\s]{5,100})"
MINISTRY = r"Ministry of ([A-Za-z &]+)"
BENEFICIARY = r"(farmer|student|women|youth|rural|urban|SC|ST|OBC|entrepreneur)"
STATE = r"(All India|All States|[A-Z][a-z]+ Pradesh|[A-Z][a-z]+ State)"
AMOUNT = r"(?:Rs\.?|₹)\s*([\d,]+)"
DOCUMENT_NAMES = r"(identity card|bank passbook|income certificate|caste certificate|ration card)"
BENEFICIARY_CLASSES = [
    ("Farmer", ["farmer"]),
    ("Student", ["student"]),
    ("Women", ["women"]),
    ("Youth", ["youth"]),
    ("Senior Citizen", ["senior citizen"]),
    ("Rural", ["rural"]),
]
DEFAULT_CLASS = "General"

# --- questions ---------------------------------------------------------------------------------
SECTION_REFERENCE = r"(?i)section\s+(\d+)"
CITED_SECTION = r"Section\s+(\d+)"
SECTION_NUMBER = r"^\d+[A-Z]?$"
AGENT_LADDER = [
    ("law_comparison", ["ipc", "changed", "old law", "difference", "compare", "बदलाव", "पुराना", "तुलना"]),
    ("scheme_eligibility", ["scheme", "yojana", "योजना", "benefit", "eligible", "subsidy", "apply",
                            "सरकारी", "लाभ", "आवेदन"]),
]
AGENT_DEFAULT = "legal_question"
APP_LADDER = [
    ("scheme_eligibility", ["scheme", "eligible", "eligibility", "योजना"]),
    ("ipc_bns_comparison", ["ipc", "compare", "changed", "difference"]),
]
APP_DEFAULT = "legal_query"
LEGAL_ROUTE, SCHEME_ROUTE, COMPARE_ROUTE = "BNSAgent", "SchemeAgent", "DiffAgent"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
DEFAULT_KEYWORD = "section"
KEYWORD_SCORE = 0.75
FALLBACK_SCORE = 0.0

# --- section map -------------------------------------------------------------------------------
CHANGE_DETAIL = {
    "deleted": "Section {old} removed entirely from BNS 2023",
    "consolidated": "Multiple IPC sections consolidated into BNS {new}",
    "renamed": "Section renumbered from IPC {old} to BNS {new}",
}
CHANGE_DETAIL_OTHER = "Modified with updates"
CHANGE_IMPACT = {
    "deleted": "This offense is no longer a crime under BNS",
    "consolidated": "Simplified structure, same legal protection",
    "renamed": "Section number changed, definition largely similar",
}
CHANGE_IMPACT_OTHER = "Review specific changes for details"

# --- wordings ----------------------------------------------------------------------------------
ASSISTANT_ROLE = (
    "You are an AI legal assistant for Indian law. You help with BNS 2023, BNSS 2023, and BSA 2023. "
    "Be concise and cite section numbers. Answer in Hindi if asked in Hindi.")
PROMPT_CONTEXT = "\n\nसंदर्भ/Context:\n"
PROMPT_QUESTION = "\n\nप्रश्न/Question: "
PROMPT_ANSWER = "\n\nउत्तर/Answer:"
ANSWER_MARK = "Answer:"
ANSWER_MARK_HINDI = "उत्तर:"
GROUNDED_PROMPT = (
    "You are a helpful legal assistant for Indian law. Answer the user's question based ONLY on the provided "
    "legal context. If the context doesn't contain enough information, say so.\n\nLegal Context:\n{context}"
    "\n\nUser Question: {question}\n\nProvide a clear, accurate answer citing specific sections when relevant."
)
SUMMARY_PROMPT = (
    "Summarize this Indian criminal law section in 2 simple sentences for a common citizen: "
    "Section {number} - {title}: {text}"
)
CLASSIFY_PROMPT = (
    "Classify this government scheme beneficiary into ONE category: Farmer, Student, Women, Youth, Senior "
    "Citizen, or General. Scheme: {name} Description: {text}"
)
ONE_WORD_PROMPT = (
    "Classify beneficiary as ONE word: Farmer, Student, Women, Youth, Rural, or General. Scheme: {text}")
EXTRACT_PROMPT = (
    "Extract from this scheme description: beneficiary type, income limit, and top 2 required documents. "
    "Scheme: {name} {text}"
)
EXPLAIN_CHANGE_PROMPT = (
    "Explain in 2 sentences how this law changed from IPC to BNS and what it means for citizens: IPC Section "
    "{old} ({old_title}) changed to BNS Section {new}. Change type: {change}. Details: {detail}"
)
COMPARE_PROMPT = (
    "Compare IPC Section {old} ({old_title}) with BNS Section {new} ({new_title}). Change type: {change}. "
    "Details: {detail}. Explain in 3 bullet points what changed and how it affects citizens."
)
COMPARE_FALLBACK_PROMPT = "How did the law on '{query}' change from IPC to BNS?"
COMPARE_RETRIEVAL_TEXT = "IPC BNS {query} section change"
SCHEME_PROMPT = (
    "A {occupation} from {state} with annual income Rs.{income} (category: {category}) is asking about eligible "
    "government schemes. From these schemes: {schemes}. List the top 3 most relevant schemes with: name, key "
    "benefit, and 2 documents needed to apply."
)
SCHEME_SUMMARY = "Found {found} schemes for {occupation} in {state}"
TEMPLATE_ANSWER = (
    "Based on the legal provisions, particularly Section {section}, {question} relates to the applicable law. "
    "Please refer to the specific section for detailed information."
)
TEMPLATE_ANSWER_PLAIN = (
    "This query relates to Indian criminal law. Please refer to the relevant BNS/BNSS/BSA sections for specific "
    "legal provisions."
)
SOURCES_ANSWER = "Based on the retrieved legal context:\n\n"
NOTHING_FOUND = "I couldn't find relevant legal information for your question."
NO_MODEL = "None (fallback mode)"

# --- evaluation --------------------------------------------------------------------------------
EVALUATION_DOMAINS = [
    "Criminal Law & Justice",
    "Civil Litigation & Procedure",
    "Constitutional & Administrative Law",
]
EVALUATION_KEYWORDS = 5
EVALUATION_KEYWORD_CHARS = 4
