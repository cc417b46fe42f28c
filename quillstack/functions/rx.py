r"""Every pattern of the inline scan, in a form that Java, RE2 and Python read alike.

\w and \b are spelt out, since they cover all of Unicode in some engines only.
"""

from __future__ import annotations

# The patterns that define the inline constructs.
EMBED = r"!\[\[([^\]|#^]+)(?:#([^\]|^]*))?(?:\^([^\]|]+))?(?:\|([^\]]+))?\]\]"
WIKI = r"(^|[^!])\[\[([^\]|#^]+)(?:#([^\]|^]*))?(?:\^([^\]|]+))?(?:\|([^\]]+))?\]\]"
ENTITY = r"&(?:#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);"
MENTION = r"(^|[^0-9A-Za-z_/\\])@([A-Za-z0-9][A-Za-z0-9_-]{0,38})(?![0-9A-Za-z_])"
ISSUE = r"(^|[^0-9A-Za-z_/&])#([0-9]+)|(?<![0-9A-Za-z_])([A-Za-z][0-9A-Za-z_.-]*/[A-Za-z][0-9A-Za-z_.-]*)#([0-9]+)|(?<=[0-9A-Za-z_])#([0-9]+)|(?<![0-9A-Za-z_])GH-([0-9]+)"
COMMIT = r"(?<![0-9A-Za-z_])([0-9a-f]{7,40})(?![0-9A-Za-z_])"
EMOJI = r":([a-z0-9_+-]{1,40}):"
MATH = r"\$([^$\n]+)\$"
URL = r"https?://[^\s<>)\]]+"
URL_TAIL = ".,;:!?)"
CALLOUT = r"^\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]\s*"
HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
LINK_DEFINITION = r"^\s{0,3}\[([^\]]+)\]:\s*(\S+)(?:\s+\"([^\"]*)\")?\s*$"
BOLD = r"\*\*([^*]+)\*\*|__([^_]+)__"
CODE = r"`([^`]+)`"
