"""Results depend on these exact numbers, words and formats."""

# --- Fixed values: text quality and limits --------------------------------------------
MAX_FILE_BYTES = 100 * 1024 * 1024
CHUNK_SIZE = 4000
CHUNK_OVERLAP = 200
LINES_PER_CHUNK = 20
TOKENS_PER_CHUNK = 200
CHARS_PER_TOKEN = 4
CHUNK_SEPARATOR = "\n---\n"
MIN_TEXT_LENGTH = 100
MIN_IMAGE_AREA = 1000
QUALITY_THRESHOLD = 0.7
WORDS_PER_MINUTE = 200
BYTES_PER_PAGE = 2000

# --- Fixed values: page layout --------------------------------------------------------
MIN_PAGE_CHARS = 50
MIN_PAGE_WORDS = 10
MIN_PAGE_LINES = 2
SIGNIFICANT_IMAGE_AREA = 10000
# Smallest image kept, in pixels: from any page, and from a page that mixes text and images.
# Books also ask for as many bytes as pixels.
SMALL_IMAGE = {"page": 1000, "mixed": 10000, "epub": 1000}
NEARBY_DISTANCE = 50
HEADER_FOOTER_WORDS = [
    "page ",
    "chapter ",
    "section ",
    "confidential",
    "proprietary",
    "copyright",
    "©",
    "®",
    "™",
]

# --- Fixed values: file kinds ---------------------------------------------------------
PROCESSOR_BY_EXT = {
    ".pdf": "PDFProcessor",
    ".epub": "EPUBProcessor",
    ".txt": "TextProcessor",
    ".srt": "TextProcessor",
    ".vtt": "TextProcessor",
    ".png": "ImageProcessor",
    ".jpg": "ImageProcessor",
    ".jpeg": "ImageProcessor",
    ".bmp": "ImageProcessor",
    ".tiff": "ImageProcessor",
}
MIME_BY_EXT = {
    ".pdf": "application/pdf",
    ".epub": "application/epub+zip",
    ".txt": "text/plain",
    ".srt": "application/x-subrip",
    ".vtt": "text/vtt",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".html": "text/html",
}
# Planner rates, seconds per MB.
DRY_RUN_RATE = {".pdf": 2.0, ".png": 0.5, ".jpg": 0.5, ".jpeg": 0.5}
DRY_RUN_RATE_OTHER = 0.1

# --- Fixed values: stored extractions --------------------------------------------------
STORE_VERSION = "2.0"
STORE_MAX_DAYS = 30
STORE_MAX_GB = 5.0
STORE_SAMPLE = 100

# --- Fixed values: run control ---------------------------------------------------------
MAX_CONSECUTIVE_FAILURES = 3
QUOTA_WORDS = ["quota", "429"]
BATCH_SIZE = 10
MOVING_AVERAGE_ROWS = 60
SLOWEST_FILES = 5
RECENT_ERRORS = 3
SAMPLE_ITEMS = 5
TEST_MODE_FILES = 3
TEST_MODE_CHUNKS = 2

# --- Fixed values: generators and prompts ----------------------------------------------
GENERATORS = ["conversations", "qa_pairs", "embeddings", "summaries"]
MEDIA_GENERATORS = ["image_descriptions", "image_qa"]
RETRY_PROMPT = (
    "Your output wasn't valid JSON. Please re-emit exactly valid JSON matching this schema:"
    "\n\n{schema}\n\nPrevious output:\n{previous}"
)
ECHO_ANSWER = "Local model result for prompt: {prompt}... (implement your logic here)."
DEFAULT_PROMPTS = {
    "conversations": "Create a natural conversation between a user and an AI assistant based on this content.",
    "qa_pairs": "Generate questions and answers based on this content.",
    "summaries": "Create a summary of this content.",
    "embeddings": "Create sentence pairs for embedding training.",
}
STYLE_PROMPTS = {
    "detailed": {
        "conversations": "Create comprehensive, detailed conversations with thorough explanations and multiple follow-up questions based on this content.",
        "qa_pairs": "Generate detailed questions with comprehensive, well-explained answers based on this content.",
        "summaries": "Create detailed summaries that cover all important aspects thoroughly based on this content.",
    },
    "concise": {
        "conversations": "Create brief, focused conversations that get straight to the point based on this content.",
        "qa_pairs": "Generate clear, direct questions with concise but complete answers based on this content.",
        "summaries": "Create brief summaries focusing only on the most essential points from this content.",
    },
    "academic": {
        "conversations": "Create scholarly conversations with proper academic discourse based on this content.",
        "qa_pairs": "Generate academic-style questions with evidence-based, well-researched answers based on this content.",
        "summaries": "Create academic summaries with proper structure and formal language based on this content.",
    },
    "casual": {
        "conversations": "Create friendly, casual conversations using everyday language based on this content.",
        "qa_pairs": "Generate approachable questions with easy-to-understand answers based on this content.",
        "summaries": "Create informal summaries using simple, conversational language based on this content.",
    },
    "creative": {
        "conversations": "Create imaginative conversations using analogies, stories, and creative examples based on this content.",
        "qa_pairs": "Generate creative questions that encourage thinking outside the box based on this content.",
        "summaries": "Create engaging summaries with creative language and interesting perspectives based on this content.",
    },
    "professional": {
        "conversations": "Create professional discussions with industry-specific terminology based on this content.",
        "qa_pairs": "Generate professional-level questions with expert insights based on this content.",
        "summaries": "Create business-focused summaries with actionable insights based on this content.",
    },
}
SYSTEM_PROMPTS = {
    "conversations": "You are an expert educator. Create natural, multi-turn conversations that help people learn. Generate realistic user questions and helpful, detailed AI responses.",
    "embeddings": "Create pairs of sentences with similar meanings but different wording. Focus on semantic similarity for training embedding models.",
    "qa_pairs": "Generate clear, specific questions that can be answered from the given content. Provide complete, accurate answers based on the source material.",
    "summaries": "Create concise, informative summaries that capture the key points and main ideas. Focus on the most important information.",
}
TASK_ROUTES = {
    "conversations": "openai/text",
    "embeddings": "openai/text",
    "qa_pairs": "openai/text",
    "summaries": "openai/text",
    "image_descriptions": "openai/vision",
}
FALLBACK_ROUTE = "deepseek/text"
ROUTE_MODELS = {
    "openai/text": "gpt-4o-mini",
    "openai/vision": "gpt-4o",
    "deepseek/text": "deepseek-r1",
    "local/text": "llama2",
}

# --- Fixed values: model catalogue ------------------------------------------------------
# (provider, model, type, max_tokens, context_window, input_per_1k, output_per_1k, image_price, priority, vision, seq)
MODEL_CATALOG = [
    ("anthropic", "claude-3-5-sonnet-20241022", "multimodal", 200000, 200000, 3.0, 15.0, None, 10, True, 1),
    ("anthropic", "claude-3-opus-20240229", "multimodal", 4096, 200000, 3.0, 15.0, None, 10, True, 2),
    ("anthropic", "claude-3-haiku-20240307", "multimodal", 4096, 200000, 3.0, 15.0, None, 10, True, 3),
    ("deepseek", "deepseek-chat", "text", 32000, None, 2.0, 5.0, None, 10, False, 1),
    ("google", "gemini-pro", "multimodal", 32000, None, 1.0, 3.0, None, 10, True, 1),
    ("google", "gemini-pro-vision", "multimodal", 32000, None, 1.0, 3.0, None, 10, True, 2),
    ("local", "local-default", "text", 4096, None, 0.0, 0.0, None, 20, False, 1),
    ("local", "local-llama", "text", 8192, None, 0.0, 0.0, None, 20, False, 2),
    ("mistral", "mistral-large-latest", "text", 32000, None, 1.2, 2.4, None, 10, False, 1),
    ("mistral", "mistral-medium-latest", "text", 32000, None, 0.8, 1.6, None, 10, False, 2),
    ("mistral", "mistral-small-latest", "text", 32000, None, 0.4, 0.8, None, 10, False, 3),
    ("openai", "gpt-4o", "multimodal", 128000, 128000, 5.0, 15.0, None, 10, True, 1),
    ("openai", "gpt-4o-mini", "multimodal", 128000, 128000, 0.15, 0.6, None, 10, True, 2),
    ("openai", "gpt-4-turbo", "multimodal", 128000, 128000, 10.0, 30.0, None, 10, True, 3),
    ("openai", "gpt-3.5-turbo", "text", 16000, 16000, 1.0, 2.0, None, 10, True, 4),
    ("openrouter", "openai/gpt-4o", "multimodal", 128000, 128000, 4.0, 13.0, None, 15, True, 1),
    ("openrouter", "openai/gpt-4o-mini", "multimodal", 128000, 128000, 0.15, 0.6, None, 15, True, 2),
    ("openrouter", "anthropic/claude-3-haiku", "multimodal", 200000, 200000, 0.25, 1.25, None, 15, True, 3),
    ("openrouter", "google/gemini-pro", "multimodal", 1000000, 1000000, 0.1, 0.1, None, 15, True, 4),
    ("openrouter", "google/gemini-2.0-flash-exp:free", "multimodal", 1000000, 1000000, 0.1, 0.1, None, 15, True, 5),
    ("openrouter", "deepseek/deepseek-chat-v3-0324:free", "multimodal", 1000000, 1000000, 0.1, 0.1, None, 15, True, 6),
]
MODEL_CATALOG_SCHEMA = (
    "provider string, model string, type string, max_tokens long, context_window long, input_per_1k double, "
    "output_per_1k double, image_price double, priority int, vision boolean, seq int"
)
