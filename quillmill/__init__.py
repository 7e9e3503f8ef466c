"""Spark-native engine that turns documents and tables into fine-tuning datasets."""

__version__ = "0.1.0"

from .errors import ConfigError, FormatError, GenerationError, ProviderError, QuillmillError, TruncatedOutputError, ValidationError
from .functions.counters import Counter, get_counter
from .operators import chunk, curate, formats, generate, messages, model, validate
from .operators.curate import split_examples
from .operators.validate import ValidationReport, validate_jsonl, validate_records
from .plans.build import BuildResult, DatasetBuilder, build_dataset, build_examples, convert_jsonl, examples_of
from .prompts import Wording, wording
from .providers import Completion, Provider
from .providers import create as create_provider
from .providers import register as register_provider
from .seams import Chunker, Curation, Generator, TokenCounter, Writer
from .sources.readers import read_documents, read_examples, read_jsonl, read_lines, read_table, rejected
from .types import Document, Example, Message, Role, documents_frame, examples_frame

__all__ = [
    "BuildResult", "Chunker", "Completion", "ConfigError", "Counter", "Curation", "DatasetBuilder", "Document", "Example", "FormatError", "GenerationError", "Generator", "Message", "Provider",
    "ProviderError", "QuillmillError", "Role", "TokenCounter", "TruncatedOutputError", "ValidationError", "ValidationReport", "Wording", "Writer", "__version__",
    "build_dataset", "build_examples", "chunk", "convert_jsonl", "create_provider", "curate", "documents_frame", "examples_frame", "examples_of", "formats", "generate", "get_counter", "messages",
    "model", "read_documents", "read_examples", "read_jsonl", "read_lines", "read_table", "register_provider", "rejected", "split_examples", "validate", "validate_jsonl",
    "validate_records", "wording",
]
