"""Scalar functions over columns: paths, command lines, output text, hashes, versions, status lines."""

from .hashing import command_hash, hash_input, rapidhash
from .paths import canonical_path, decanonicalize, dir_name, shell_escape, win32_escape
from .status import format_mtime, format_rate, now_millis, percent, predicted_share, progress_line, status_text
from .text import atoi, edit_distance, elide_middle, elide_middle_ansi, exit_status, inline_response_file, json_escape, show_includes, strip_ansi, suggestion, version_check, version_pair

__all__ = [
    "atoi", "canonical_path", "command_hash", "decanonicalize", "dir_name", "edit_distance", "elide_middle", "elide_middle_ansi", "exit_status", "format_mtime", "format_rate",
    "hash_input", "inline_response_file", "json_escape", "now_millis", "percent", "predicted_share", "progress_line", "rapidhash", "shell_escape", "show_includes",
    "status_text", "strip_ansi", "suggestion", "version_check", "version_pair", "win32_escape",
]
