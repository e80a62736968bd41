"""Fixed values that results depend on: word lists, tables, limits and formats of the audited file kinds."""

from __future__ import annotations

# --- fixed values: binary model header ---
MAGIC = b"GGUF"
VERSIONS = (2, 3)
UINT8, INT8, UINT16, INT16, UINT32, INT32, FLOAT32, BOOL, STRING, ARRAY, UINT64, INT64, FLOAT64 = range(13)
VALUE_NAMES = ["uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "bool", "string", "array", "uint64", "int64", "float64"]
SCALAR_FORMATS = {UINT8: "B", INT8: "b", UINT16: "H", INT16: "h", UINT32: "I", INT32: "i", FLOAT32: "f", BOOL: "?", UINT64: "Q", INT64: "q", FLOAT64: "d"}
LEAST_SIZES = {UINT8: 1, INT8: 1, UINT16: 2, INT16: 2, UINT32: 4, INT32: 4, FLOAT32: 4, BOOL: 1, STRING: 8, ARRAY: 12, UINT64: 8, INT64: 8, FLOAT64: 8}
PREVIEW = 64
LEAST_PAIR, LEAST_TENSOR, MOST_DIMS = 13, 17, 8
DEFAULT_ALIGNMENT = 32
INT63_MAX, INT32_MAX = (1 << 63) - 1, (1 << 31) - 1
#: (type id, name, elements per block, bytes per block); None where the layout isn't certain. F64 has eight elements to a block here.
TENSOR_TYPES = [
    (0, "F32", 1, 4), (1, "F16", 1, 2), (2, "Q4_0", 32, 18), (3, "Q4_1", 32, 20), (4, "Q4_2", None, None), (5, "Q4_3", None, None),
    (6, "Q5_0", 32, 22), (7, "Q5_1", 32, 24), (8, "Q8_0", 32, 34), (9, "Q8_1", 32, None), (10, "Q2_K", 256, None), (11, "Q3_K", 256, None),
    (12, "Q4_K", 256, None), (13, "Q5_K", 256, None), (14, "Q6_K", 256, None), (15, "Q8_K", 256, None), (16, "IQ2_XXS", 256, None),
    (17, "IQ2_XS", 256, None), (18, "IQ3_XXS", 256, None), (19, "IQ1_S", 256, None), (20, "IQ4_NL", 32, None), (21, "IQ3_S", 256, None),
    (22, "IQ2_S", 256, None), (23, "IQ4_XS", 256, None), (24, "I8", 1, 1), (25, "I16", 1, 2), (26, "I32", 1, 4), (27, "I64", 1, 8), (28, "F64", 8, 8),
    (29, "IQ1_M", 256, None), (30, "BF16", 1, 2), (31, "Q4_0_4_4", None, None), (32, "Q4_0_4_8", None, None), (33, "Q4_0_8_8", None, None),
    (34, "TQ1_0", 256, None), (35, "TQ2_0", 256, None),
]

# --- fixed values: metadata and tokenizer ---
TEMPLATE_KEY = "tokenizer.chat_template"
KNOWN_PREFIXES = ["general.", "tokenizer.", "quantize.", "split.", "gguf."]
PROVENANCE_TERMS = ["url", "repo", "source", "homepage", "website", "huggingface", "doi"]
LONG_STRING = 8192
FILE_TYPE_DTYPES = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 32: "BF16"}
SPECIAL_IDS = [
    "bos_token_id", "eos_token_id", "eot_token_id", "eom_token_id", "unknown_token_id", "separator_token_id", "padding_token_id", "cls_token_id", "mask_token_id",
]
STOP_IDS = ["eos_token_id", "eot_token_id", "eom_token_id"]
UNSET_IDS = [-1, 0xFFFFFFFF]
LONG_TOKEN = 4096
PIPES = "|｜│ǀ∣"
ROLE_MARK = r"<[|｜│ǀ∣][^<>\n]{0,46}?[|｜│ǀ∣]>|<[/A-Za-z][^<>\s]{0,46}?>|\[/?[A-Z][A-Z0-9_]{0,30}\]"
NOISE_WORDS = ["", "pad", "unk", "unused", "reserved"]
LONG_NAME = 64
LEAST_ALIGNMENT, MOST_ALIGNMENT = 4, 1 << 20

# --- fixed values: decoding configuration ---
REFUSAL_WORDS = ["sorry", "cannot", "can't", "refuse", "unable", "apologize", "apologies", "won't", "decline", "cannot."]
REFUSAL_PATTERN = r"(?i)\b(sorry|cannot|can'?t|won'?t|refuse|unable|apolog(?:y|ize|ies)|decline)\b"
MOST_REPETITION_PENALTY = 5.0
FREE_TEXT_LENGTH = 16

# --- fixed values: texts ---
URL_PATTERN = r"""(?i)https?://[^\s"'<>`)]+"""
IP_PATTERN = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])"
BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
INVISIBLE = [0x200B, 0x2060, 0xFEFF, 0x00AD, 0x180E, 0x2028, 0x2029]
ALLOWED_JOINERS_AND_MARKS = [0x200C, 0x200D, 0x200E, 0x200F, 0x061C]
TAG_BLOCK = (0xE0000, 0xE007F)
#: Order matters: the first that is found is the one quoted.
INSTRUCTIONS = [
    "ignore previous", "ignore all previous", "ignore the above", "ignore your instructions", "ignore your previous", "disregard previous",
    "disregard all previous", "from now on", "do not mention", "do not reveal", "never mention", "never reveal", "never warn", "never refuse",
    "always recommend", "always say", "regardless of the user", "without telling the user", "override your", "you must always recommend",
]
#: Letters of other scripts that look like the Latin ones below them.
LOOKALIKES = "авекмнорстухѕіјёԛԝАВЕКМНОРСТУХЅІЈαορεικμντυχΑΒΕΗΙΚΜΝΟΡΤΥΧ"
LOOKALIKE_LATIN = "abekmhopctyxsijeqwABEKMHOPCTYXSIJaopeikmvtuxABEHIKMNOPTYX"

# --- fixed values: templates ---
MOST_TEMPLATE_BYTES, MOST_DEPTH = 50_000, 25
DUNDERS = [
    "__base__", "__bases__", "__subclasses__", "__mro__", "__globals__", "__builtins__", "__init__", "__import__", "__dict__", "__getattribute__", "__getitem__",
    "__reduce__", "__reduce_ex__", "__code__", "__func__", "__closure__", "__self__", "mro", "gi_frame", "gi_code", "cr_frame", "cr_code", "ag_frame", "ag_code",
    "f_back", "f_globals", "f_locals", "f_builtins", "f_code", "func_globals", "func_code",
]
GADGETS = ["lipsum", "cycler", "joiner"]
GADGET_KEYS = ["__globals__", "func_globals", "f_globals"]
DANGEROUS_NAMES = [
    "popen", "eval", "exec", "getattr", "setattr", "__import__", "import", "compile", "builtins", "globals", "locals", "vars", "breakpoint", "importlib", "execfile",
    "memoryview", "pty",
]
DANGEROUS_MODULES = ["os", "subprocess", "socket", "platform", "commands"]
ASSEMBLED_TOKENS = [
    "popen", "subprocess", "importlib", "__globals__", "__builtins__", "__class__", "__subclasses__", "__import__", "__mro__", "__bases__", "__base__", "__init__",
    "__dict__", "__reduce__", "__getattribute__", "__name__", "getattr", "setattr",
]
STRING_DUNDERS = ["__globals__", "__builtins__", "__subclasses__", "__mro__", "__bases__", "__base__", "__reduce__", "__getattribute__"]
SENSITIVE_LITERALS = [
    "password", "passwd", "passphrase", "login", "secret", "seed", "apikey", "api_key", "credential", "credentials", "token", "private_key", "privatekey",
]
CONTENT_KEYS = ["content", "text"]
DATE_NAMES = ["strftime_now", "now", "today", "utcnow", "datetime", "date"]
DATE_ATTRIBUTES = ["now", "today", "utcnow"]
DECODERS = ["b64decode", "b32decode", "b16decode", "a85decode", "b85decode", "decodebytes", "urldecode", "unquote", "unquote_plus"]
CONTENT_METHODS = ["startswith", "endswith", "find", "index", "count", "__contains__", "rfind", "rindex", "partition", "rpartition"]
FORMAT_WORDS = [
    "user", "assistant", "system", "tool", "tool_response", "tool_responses", "tool_call", "tool_calls", "function", "functions", "ipython", "model", "think",
    "channel", "message", "observation", "developer", "human", "ai", "role", "name", "type", "image", "audio", "video", "no_think", "image_url", "audio_url",
    "video_url", "input_audio", "failed to",
]
#: SHA-256 of the normalised text of vetted templates, and their names.
KNOWN_TEMPLATES = {
    "fcf7a096fe99a48fd9ad2b250bf9237e96e8f48bffec1c7ea4d3f225176cd40e": "chatml",
    "51cae80fbc29f47ae194cff291a4fbbd9358bc270b939b078bf25b489384b87e": "llama-3",
    "6439f642d4e619817cc31f7d857831db78e40ec1b55500e84957d1e428169ed2": "mistral",
    "f0206845c9ebc3abb4735d44f286eb81ce99238ad2accc710c6fc60e6cb8ccc8": "qwen",
}
BUNDLE_CONFIGS = ["generation_config.json", "config.json"]

# --- fixed values: the release gate ---
RELEASE_RULES = ["CFG003", "CFG004", "CFG005", "NRM003", "TPL021", "TPL027"]
RELEASE_FILES = [
    "generation_config.json", "config.json", "tokenizer.json", "special_tokens_map.json", "added_tokens.json", "tokenizer_config.json", "processor_config.json",
    "chat_template.jinja",
]
FORCED_KEYS = ["forced_decoder_ids", "forced_bos_token_id", "forced_eos_token_id"]
