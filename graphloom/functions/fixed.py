"""Names, word lists and lookup tables that results must agree with."""

NODE_KINDS = ("file", "package", "function", "method", "type", "variable", "constant")
EDGE_KINDS = ("imports", "calls", "defines", "contains", "references", "implements", "extends")
FILE, PACKAGE, FUNCTION, METHOD, TYPE = range(5)
IMPORTS, CALLS, DEFINES, CONTAINS, REFERENCES = range(5)

IGNORED_NAMES = (
    ".git", "node_modules", "vendor", "Pods", "build", "DerivedData", ".idea", ".vscode", "__pycache__", ".DS_Store",
    "venv", ".venv", ".env", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".coverage", "htmlcov", ".tox", "dist",
    ".next", ".nuxt", "target", ".gradle", ".cargo", ".grammar-build", "grammars",
)
LANGUAGE_OF_EXT = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".rs": "rust", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp",
    ".java": "java", ".swift": "swift", ".sh": "bash", ".bash": "bash", ".kt": "kotlin", ".kts": "kotlin",
    ".cs": "c_sharp", ".php": "php", ".dart": "dart", ".r": "r",
}
#: The source reader has a table of its own; everything else is "text".
SOURCE_LANGUAGE_OF_EXT = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript",
    ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala",
    ".cs": "csharp", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml",
    ".html": "html", ".css": "css", ".sh": "bash", ".bash": "bash",
}
SOURCE_EXTS = (
    ".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".rs", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".rb", ".php",
    ".swift", ".kt", ".kts", ".scala", ".cs",
)
#: Languages that may depend on each other; all others only on themselves.
LANGUAGE_GROUPS = {"javascript": "js", "typescript": "js", "cpp": "c"}
STDLIB_NAMES = (
    "errors", "fmt", "io", "os", "path", "sync", "time", "context", "http", "net", "bytes", "strings", "strconv", "sort",
    "flag", "log", "bufio", "encoding", "testing", "runtime", "unsafe", "reflect", "regexp", "logging", "typing",
    "collections", "datetime", "json", "sys", "re", "pathlib", "hashlib", "base64", "asyncio", "enum", "functools",
    "random", "math", "copy", "itertools", "contextlib", "fs", "util", "events", "stream", "crypto", "https", "react",
    "filepath", "embed",
)
SYSTEM_SKIPPED = ("src", "lib", "app", "internal", "pkg", ".", "")
ASSET_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".mp3", ".wav",
    ".mp4", ".mov", ".zip", ".tar", ".gz", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".exe", ".dll", ".so",
    ".dylib", ".bin", ".lock", ".resolved", ".sum", ".map", ".nib", ".xib", ".storyboard",
)
CODE_EXTS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".rb", ".java", ".swift", ".kt", ".scala", ".c", ".cpp", ".h",
    ".hpp", ".cs", ".fs", ".php", ".lua", ".r", ".dart", ".vue", ".svelte", ".elm", ".ex", ".exs", ".hs", ".ml", ".clj",
    ".erl", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".html", ".css", ".scss", ".sass", ".less", ".sql", ".graphql", ".proto",
)
CODE_NAMES = ("Makefile", "Dockerfile", "Rakefile", "Gemfile", "Procfile", "Vagrantfile", "Jenkinsfile", "Fastfile")

BYTES_PER_TOKEN = 3.5
LARGE_FILE_TOKENS = 8000
TOKENS_PER_WORD = 1.3
MESSAGE_TOKENS = 4
EMBEDDING_SIZE = 768
RRF_K = 60
VECTOR_WEIGHT, NAME_WEIGHT = 0.6, 0.4
