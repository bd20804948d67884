"""Regular expressions in RE2 notation, turned into java.util.regex notation of the same meaning."""

from __future__ import annotations

import re

_BOUNDARY = r"(?-iu:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_SPACE = r"\t\n\f\r "


def java(pattern: str) -> str:
    """Java's line ends, word boundaries, white space and case folding differ from RE2's; the result agrees with RE2."""
    out, at, in_class, multiline = ["(?d)"], 0, False, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            two = pattern[at : at + 2]
            at += 2
            if two == "\\b" and not in_class:
                out.append(_BOUNDARY)
            elif two == "\\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif two == "\\S" and not in_class:
                out.append(f"[^{_SPACE}]")
            else:
                out.append(two)
            continue
        flags = re.match(r"\(\?([imsU]+)([:)])", pattern[at:])
        if flags and not in_class:
            multiline |= "m" in flags[1]
            out.append(f"(?{flags[1]}d{'u' if 'i' in flags[1] else ''}{flags[2]}")
            at += len(flags[0])
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[at + 1 : at + 2] == "^":
                out.append("^")
                at += 1
        else:
            out.append("\\z" if c == "$" and not multiline else c)
        at += 1
    return "".join(out)


# The patterns of signals, secrets and redaction. Their wording decides results.
CORRECTION = r"(?i)\b(no|not|wrong|incorrect|actually|instead|change|fix|retry|try again|again|re-run|rerun|doesn['’]?t work|failed)\b|不对|不正确|不是这样|改一下|修改|重试|再试|重新|失败|报错|应该"
ACCEPTANCE = r"(?i)\b(yes|yep|yeah|correct|right|looks good|good|great|perfect|thanks|thank you|works|working|approved|accept|ship it|done)\b|可以|正确|对的|很好|完美|谢谢|通过|批准|发布|搞定|没问题"
DECISION = r"(?i)\b(decide|decision|choose|choice|recommend|prefer|should we|use)\b|决定|选择|建议|采用|使用|取舍|方案"
QUESTION = r"(?i)\?|\b(how|what|why|when|where|which|can|could)\b|怎么|如何|什么|为什么|是否|哪个"
WORKFLOW = r"(?i)\b(always|workflow|process|step[- ]by[- ]step|runbook|standard|reusable|repeatable|from now on)\b|以后|流程|步骤|规范|可复用|重复使用|长期"
ONE_OFF = r"(?i)\b(one[- ]off|one time|just this once|temporary|temp|quick fix|throwaway)\b|一次性|临时|只要这次|快速修一下"
TEST_PASSED = r"(?i)(?:\b(?:go test|cargo test|pytest|npm test|yarn test|pnpm test|vitest|jest|gradle test|mvn test)\b[^\n]*\b(?:pass|passed|ok|success|successful|green)\b)|(?:\b(?:all tests?|tests?)\b[^\n]*(?:pass|passed|ok|success|successful|green)\b)|(?:测试(?:全部|都)?通过)|(?:\b0\s+(?:failures?|failed)\b)|(?m)^\s*(?:ok|PASS)\b"
TEST_FAILED = r"(?i)(?:\b(?:go test|cargo test|pytest|npm test|yarn test|pnpm test|vitest|jest|gradle test|mvn test)\b[^\n]*\b(?:fail|failed|failure|error|panic|did not pass|does not pass|doesn['’]?t pass|not passing)\b)|(?:\b(?:tests?|test suite)\b[^\n]*(?:fail|failed|failure|error|panic|did not pass|does not pass|doesn['’]?t pass|not passing)\b)|(?:测试失败|测试报错|panic|build failed)|(?m)^\s*FAIL\b"
SECRET_TOKEN = r"(?i)\b(?:sk|pk|rk)[_-][A-Za-z0-9][A-Za-z0-9_-]{8,}\b|\b(?:ghp|github_pat|xox[baprs]|glpat)[_-][A-Za-z0-9][A-Za-z0-9_-]{8,}\b|\bAKIA[0-9A-Z]{16}\b|\bBearer\s+[A-Za-z0-9._~+/=-]{16,}"
SECRET_ASSIGNMENT = r"""(?i)\b[A-Za-z0-9_]*(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)\b\s*[:=]\s*(?:"[^"]*"|'[^']*'|[^\s&,;]+)"""
SLACK_WEBHOOK = r"""(?i)\bhttps?://hooks\.slack\.com/services/[^\s"'<>]+"""
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"
SECRETS = [SECRET_TOKEN, SECRET_ASSIGNMENT, SLACK_WEBHOOK, JWT, PRIVATE_KEY]
#: Pattern, replacement; \1 is the first group. The order matters.
REDACTIONS = [
    (r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED_TOKEN]"),
    (r"(?i)\b(?:sk|pk|rk)[_-][A-Za-z0-9][A-Za-z0-9_-]{8,}\b|\b(?:ghp|github_pat|glpat|xox[baprs])[_-][A-Za-z0-9][A-Za-z0-9_-]{8,}\b|\bAKIA[0-9A-Z]{16}\b", "[REDACTED_TOKEN]"),
    (SLACK_WEBHOOK, "[REDACTED_TOKEN]"),
    (JWT, "[REDACTED_TOKEN]"),
    (SECRET_ASSIGNMENT, "[REDACTED_SECRET]"),
    (r"""(?i)("[^"]*(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)[^"]*"\s*:\s*)"(?:\\.|[^"\\])*\"""", r'\1"[REDACTED_SECRET]"'),
    (r"(?i)(://[^:/\s]+:)[^@\s]+@", r"\1[REDACTED_CREDENTIAL]@"),
    (r"(?i)([?&](?:api[_-]?key|access[_-]?key|secret|token|password|passwd)=)[^&#\s]+", r"\1[REDACTED_SECRET]"),
    (r"\b[A-Za-z0-9._%+!-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"""(^|[\s"'=(])(?:file://)?(?:~/|/(?:Users|home|var/folders|private/var|tmp)/)[^\s"'<>]+""", r"\1[REDACTED_PATH]"),
    (r"""(?i)\b[A-Z]:\\[^\s"'<>]+""", "[REDACTED_PATH]"),
]
#: Lower-case strings of which a text that one of these patterns matches must hold at least one; the patterns themselves are slow.
_TOKENS = ["sk_", "sk-", "pk_", "pk-", "rk_", "rk-", "ghp", "github_pat", "xox", "glpat", "akia"]
_NAMES = ["key", "secret", "token", "passw"]
SECRET_HINTS = [[*_TOKENS, "bearer"], _NAMES, ["hooks.slack.com"], ["eyj"], ["-----begin "]]
#: What earlier replacements leave behind has names in it, so their hints are hints of names, too.
_LATER = [*_NAMES, "-----begin ", "bearer", *_TOKENS, "hooks.slack.com", "eyj"]
REDACTION_HINTS = [["-----begin "], ["bearer"], _TOKENS, ["hooks.slack.com"], ["eyj"], _LATER, _LATER, ["://"], _LATER, ["@"], ["~/", "/users/", "/home/", "/var/", "/private/", "/tmp/"], [":\\"]]
FENCED_CODE, INLINE_CODE = r"(?s)```.*?```", r"`[^`]*`"
MARKDOWN_LINK, MARKDOWN_MARKER = r"!?(?:\[[^\]]*\])\([^)]*\)", r"(?m)^\s{0,3}(?:[#>*+\-]|\d+[.)])\s+"
INJECTED_NOISE = r"(?is)^\s*(?:<environment_context\b|<cwd\b|<system(?:-reminder)?\b|<user_info\b|<permissions(?:\s+instructions)?\b|\[system(?:-reminder)?\]|\[environment_context\b|(?:#+\s*)?agents\.md\b|(?:#+\s*)?context\s+from\s+my\s+ide\s+setup\b|#+\s+(?:skills|available\s+skills)\b|(?:you must|must follow|do not|don't|never)\b)"
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
