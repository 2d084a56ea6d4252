"""Scalar Column functions (B1-B27). All are compositions of built-in expressions: no Python UDFs."""

from tidemark.functions.digest import (content_digest, digest_from_store_path, digest_kind, hex40_to_base32,
                                       is_valid_digest, store_location, store_path_valid)
from tidemark.functions.surt import (surt_canonical_url, surt_domain, surt_from_url, surt_host_key, surt_parse,
                                     surt_path, surt_text, url_parts)
from tidemark.functions.text import analyse, first_line, html_escape, html_unescape, raw_tokens
from tidemark.functions.timefmt import (capture_year, date_param, from_epoch_seconds, half_open, to_epoch_seconds,
                                        ts14_format, ts14_parse)
from tidemark.functions.urls import (archive_url, archive_url_parse, checked_long, gravatar_hash, mime_type, page_link,
                                     pattern_from_query, pattern_query, redirect_file_valid, redirect_html,
                                     redirect_target, remove_dot_segments, resolve_reference, status_code, status_code_error, status_url_parts)

__all__ = [
    "analyse", "archive_url", "archive_url_parse", "capture_year", "checked_long", "content_digest", "date_param",
    "digest_from_store_path", "digest_kind", "first_line", "from_epoch_seconds", "gravatar_hash", "half_open",
    "hex40_to_base32", "html_escape", "html_unescape", "is_valid_digest", "mime_type", "page_link", "pattern_from_query", "pattern_query",
    "raw_tokens", "redirect_file_valid", "redirect_html", "redirect_target", "remove_dot_segments", "resolve_reference", "status_code",
    "status_code_error", "status_url_parts", "store_location", "store_path_valid", "surt_canonical_url",
    "surt_domain", "surt_from_url", "surt_host_key", "surt_parse", "surt_path", "surt_text", "to_epoch_seconds",
    "ts14_format", "ts14_parse", "url_parts",
]
