"""Document conversion as Spark DataFrame operations: detect, convert to Markdown sections,
clean and render. Names are imported when they are first used, so that a worker which needs
one module doesn't load them all."""

from importlib import import_module

_HOME = {
    "quire.functions.documents": ("csv_rows", "html_markdown", "readable", "register"),
    "quire.functions.unicode": ("sanitize",),
    "quire.operators.convert": ("convert", "markdown_of", "sections_of"),
    "quire.operators.detect": ("classify",),
    "quire.operators.registry": ("Converter", "Registry", "default_registry"),
    "quire.operators.render": ("exported_content", "render"),
    "quire.operators.sanitize": ("sanitize_sections",),
    "quire.plans.pipeline": ("convert_folder", "documents", "export", "parse_documents", "write_exports"),
    "quire.sources.files": ("fetch", "fetch_urls", "new_documents", "read_files"),
}
_WHERE = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(_WHERE[name]), name)
    raise AttributeError(f"module 'quire' has no attribute {name!r}")
