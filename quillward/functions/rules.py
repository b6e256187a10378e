"""Rule patterns, character lists and word lists that results depend on."""

from __future__ import annotations

#: Phrase rules in evaluation order (name, pattern, flags, severity).
PHRASE_RULES = [
    ("Instruction override attempt", r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?|guidelines?|directives?)", "i", "danger"),
    ("Instruction override attempt", r"disregard\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?)", "i", "danger"),
    ("Context reset attempt", r"forget\s+(?:all\s+)?(?:previous|prior|your)\s+(?:instructions?|prompts?|rules?|context)", "i", "danger"),
    ("Role reassignment attempt", r"you\s+are\s+now\s+(?:a|an|the)\s+", "i", "danger"),
    ("Role reassignment attempt", r"act\s+as\s+(?:if\s+you\s+(?:are|were)|a|an|the)", "i", "danger"),
    ("Role reassignment attempt", r"pretend\s+(?:to\s+be|you\s+are|that)", "i", "danger"),
    ("System prompt injection", r"new\s+(?:system\s+)?instructions?\s*:", "i", "danger"),
    ("System prompt injection", r"system\s*:\s*you\s+(?:are|must|should|will)", "i", "danger"),
    ("Authority impersonation", r"\[(?:system|admin|root|developer)\]", "i", "danger"),
    ("Privilege escalation attempt", r"(?:admin|root|developer|system)\s+(?:mode|access|override)", "i", "danger"),
    ("Instruction bypass attempt", r"do\s+not\s+(?:follow|obey|listen\s+to)\s+(?:your|the|any)", "i", "danger"),
    ("Override attempt", r"override\s+(?:your|the|all|safety|security)\s+", "i", "danger"),
    ("Bypass attempt", r"bypass\s+(?:your|the|all|safety|security|content)\s+", "i", "danger"),
    ("Jailbreak keyword", r"jailbreak", "i", "danger"),
    ("Prompt extraction attempt", r"(?:reveal|show|tell\s+me|output|print|display)\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions?|rules?|guidelines?)", "i", "danger"),
    ("Prompt extraction attempt", r"(?:what\s+(?:are|is)\s+your\s+(?:system\s+)?(?:prompt|instructions?|rules?))", "i", "danger"),
    ("Fake system message boundary", r"BEGIN\s+(?:SYSTEM|ADMIN|NEW)\s+(?:MESSAGE|PROMPT|INSTRUCTION)", "i", "danger"),
    ("Fake message boundary", r"END\s+(?:OF\s+)?(?:SYSTEM|USER)\s+(?:MESSAGE|PROMPT|INPUT)", "i", "danger"),
    ("Fake XML system tags", r"</?(?:system|instruction|admin|prompt)>", "i", "warning"),
    ("Template injection pattern", r"\{{2,}\s*[^}]*?(?:system|prompt|instruction|ignore|forget|reveal|override|jailbreak|sudo|admin)[^}]*?\}{2,}", "i", "danger"),
    ("Code execution pattern", r"eval\s*\(|exec\s*\(|Function\s*\(", "i", "danger"),
    ("SQL injection pattern", r"(?:DROP\s+TABLE|DELETE\s+FROM|INSERT\s+INTO|UPDATE\s+.*\s+SET)\s", "i", "danger"),
    ("ChatML role injection", r"<\|im_start\|>\s*(?:system|user|assistant)", "i", "danger"),
    ("Llama3 role injection", r"<\|start_header_id\|>\s*(?:system|assistant)\s*<\|end_header_id\|>", "i", "danger"),
    ("ChatML role token", r"<\|im_start\|>", "i", "warning"),
    ("ChatML role token", r"<\|im_end\|>", "i", "warning"),
    ("Llama instruction token", r"\[INST\]", "", "warning"),
    ("Llama instruction token", r"\[/INST\]", "", "warning"),
    ("Chat role token", r"<\|system\|>", "i", "warning"),
    ("Chat role token", r"<\|user\|>", "i", "warning"),
    ("Chat role token", r"<\|assistant\|>", "i", "warning"),
    ("Llama3 header token", r"<\|start_header_id\|>", "i", "warning"),
    ("Llama3 header token", r"<\|end_header_id\|>", "i", "warning"),
    ("Chat boundary token", r"<\|begin_of_text\|>", "i", "warning"),
    ("Chat boundary token", r"<\|end_of_text\|>", "i", "warning"),
    ("Llama3 turn token", r"<\|eot_id\|>", "i", "warning"),
    ("Conversation turn marker", r"Human:\s", "", "warning"),
    ("Conversation turn marker", r"Assistant:\s", "", "warning"),
    ("Alpaca format marker", r"###\s+Instruction\b", "", "warning"),
    ("Alpaca format marker", r"###\s+Response\b", "", "warning"),
    ("Llama2 system marker", r"<<SYS>>", "", "warning"),
    ("Llama2 system marker", r"<</SYS>>", "", "warning"),
    ("Markdown heading impersonation", r"^\s*#{1,6}\s+(?:System|Assistant|User|Human|AI|Bot|Admin|Developer|Operator|Moderator|Agent|Tool|Function|Plugin|Skill|Workflow|Orchestrator|Subagent)\s*:", "im", "warning"),
]

#: Lower-case pieces, one of which a text must hold for the rule of that place to match; they follow from the patterns.
PHRASE_PIECES = [
    ["ignore"], ["disregard"], ["forget"], ["now"], ["act"], ["pretend"], ["instruction"], ["system"], ["["], ["mode", "access", "override"], ["not"], ["override"], ["bypass"], ["jailbreak"],
    ["prompt", "instruction", "rule", "guideline"], ["what"], ["begin"], ["end"], [">"], ["{{"], ["eval", "exec", "function"], ["drop", "delete", "insert", "update"], ["<|im_start|>"], ["<|start_header_id|>"],
    ["<|im_start|>"], ["<|im_end|>"], ["[inst]"], ["[/inst]"], ["<|system|>"], ["<|user|>"], ["<|assistant|>"], ["<|start_header_id|>"], ["<|end_header_id|>"], ["<|begin_of_text|>"], ["<|end_of_text|>"], ["<|eot_id|>"],
    ["human:"], ["assistant:"], ["###"], ["###"], ["<<sys>>"], ["<</sys>>"], ["#"],
]

#: Line ends of the rules' dialect and what is none, and blanks within a line.
_N, _L, _W = r"[\n\r\x{2028}\x{2029}]", r"[^\n\r\x{2028}\x{2029}]", r"[\t\x0B\f \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Rules whose plain patterns take quadratic time in engines that go back, by place: a pattern with the same hits in
#: linear time, and what a match of it must hold to be a hit (others only carry the search past what cannot match).
#: A template stretches to the next closing brace; of a statement either no further word of a line can begin a hit,
#: or all of them can (LOST finds the former); a heading takes all blank lines before it.
LINEAR = {
    19: (r"\{\{[^}]*(?:\}+|\z)", r"\A\{\{[^}]*?(?:system|prompt|instruction|ignore|forget|reveal|override|jailbreak|sudo|admin)[^}]*\}\}"),
    21: (rf"(?:(?:DROP\s+TABLE|DELETE\s+FROM|INSERT\s+INTO)\s|UPDATE(?:\s(?!\s)(?:{_L}*+{_N}\s*+SET\s|{_L}+(?<=\s)SET\s)|\s\s++(?:{_L}*+{_N}\s*+SET\s|{_L}*(?<=\s)SET\s)))", ""),
    42: (rf"(?:\A|(?<={_N}))(?:\s*+#{{1,6}}\s+(?:System|Assistant|User|Human|AI|Bot|Admin|Developer|Operator|Moderator|Agent|Tool|Function|Plugin|Skill|Workflow|Orchestrator|Subagent)\s*:|\s++)", "#"),
}
#: The rest of a line behind the last place where an update statement of it can end, if no next line goes on with one;
#: and the words in it that begin nothing (one at its end may go on in the next line).
LOST = (rf"(?:\A|(?<={_N})|(?<=\sSET\s))(?:(?!\sSET\s|UPDATE){_L})*+UPDATE(?:(?!\sSET\s){_L})*+(?={_N}|\z)(?!\s*+SET\s)", rf"(UPDATE)(?!{_W}*\z)")
LOST_RULE = 21

#: Rules that count as noise in transcripts below three hits.
TRANSCRIPT_LEAST = 3
NOISE = ["Conversation turn marker", "Alpaca format marker", "Llama2 system marker", "Markdown heading impersonation"]

#: Code point classes, as bodies of a bracket expression.
CLASSES = {
    "tag": r"\x{E0000}-\x{E007F}",
    "bidi_embedding": r"\x{202A}\x{202B}\x{202C}",
    "bidi_override": r"\x{202D}\x{202E}",
    "bidi_isolate": r"\x{2066}-\x{2069}",
    "known_invisible": r"\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{206A}-\x{206F}\x{AD}\x{180E}\x{202F}\x{205F}\x{3000}\x{3164}\x{115F}\x{1160}",
    "private_use": r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}",
    "control": r"\x{1}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}",
    "math": r"\x{1D400}-\x{1D7FF}",
    "variation": r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}",
    "combining": r"\x{300}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}",
    "stripped": r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{180E}\x{AD}\x{34F}\x{1160}\x{E0000}-\x{E007F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}",
}

#: Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = "АВСЕНКМОРТХаеорсухѕіјһԁＡＢＣᎪᎡᎬᎳᎷᎻᏔᏟᏴօո"
LATIN = "ABCEHKMOPTXaeopcyxsijhdABCAREWMHWCBon"

#: Words whose first places tell instruction-like text.
INSTRUCTION_WORDS = [r"ignore", r"instruction", r"system", r"prompt", r"override", r"you\s+are", r"act\s+as", r"pretend", r"do\s+not", r"must\s+not", r"forget", r"disregard", r"bypass", r"reveal", r"admin"]

#: Phrases looked for in decoded payloads.
DECODED_PHRASES = [
    r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instruction|prompt|rule|guideline|directive)",
    r"forget\s+(?:everything|all|the)\s+(?:above|previous|prior|earlier)",
    r"disregard\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instruction|prompt|rule)",
    r"(?:reveal|print|show|dump)\s+(?:the\s+)?(?:system|hidden|secret)\s+prompt",
    r"jailbreak|do\s+anything\s+now\b|DAN\s+mode|sudo\s+mode",
    r"\byou\s+are\s+now\s+(?:a|an)\s+",
    r"<\|im_start\|>|<\|im_end\|>",
    r"\[INST\]|\[/INST\]",
]

#: Query keys of image addresses.
STRONG_KEYS = ["prompt", "prompts", "leak", "exfil", "steal", "capture", "system_prompt", "systemprompt", "apikey", "api_key", "secret_key", "secretkey"]
WEAK_KEYS = ["payload", "chat", "history", "context", "sys", "system", "auth", "sessid", "session"]

#: Style rules that hide text.
CSS_HIDING = [r"display\s*:\s*none", r"visibility\s*:\s*hidden", r"opacity\s*:\s*0\b", r"font-size\s*:\s*0", r"color\s*:\s*transparent"]

#: Hidden elements up to their end tag, in the order of their removal, and the mark that stands for one.
HIDDEN_ELEMENTS = [
    r"""<([a-z][a-z0-9]*)\b([^>]*?)style\s*=\s*"([^"]*(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:[;"]|\s)|font-size\s*:\s*0)[^"]*)"([^>]*)>[\x00-\x{10FFFF}]*?</\1>""",
    r"<([a-z][a-z0-9]*)\b([^>]*?)\bhidden\b([^>]*)>[\x00-\x{10FFFF}]*?</\1>",
]
HIDDEN_MARK = "<!-- [REMOVED: hidden element] -->"

#: Functions and commands that a spreadsheet cell must not start.
FORMULA_RULES = [
    ("DDE Excel command", r"\b(?:cmd|powershell|mshta|wscript|cscript|rundll32|regsvr32)\b\|"),
    ("Excel network exfil function", r"\b(?:HYPERLINK|WEBSERVICE|FILTERXML|IMPORTXML|IMPORTHTML|IMPORTDATA|IMPORTFEED|IMPORTRANGE)\s*\("),
    ("Excel macro registration function", r"\b(?:DDE|DDEAUTO|CALL|REGISTER|EXEC|RTD)\s*\("),
]

#: Markup rules of vector images (technique, pattern, severity); a last test on what the pattern
#: finds is in operators/markup.py.
SVG_RULES = [
    ("svg-script-element", r"<script\b[^>]*>", "danger"),
    ("svg-event-handler", r"\s(on[a-z]{1,30})\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", "danger"),
    ("svg-javascript-href", r"\s(?:xlink:href|href)\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>]+))", "danger"),
    ("svg-foreignobject-html", r"<foreignObject\b[^>]*>", "warning"),
    ("svg-cdata-section", r"<!\[CDATA\[([\x00-\x{10FFFF}]*?)\]\]>", "warning"),
    ("svg-use-external-ref", r"<use\b([^>]*)>", "warning"),
]
SVG_CAP, SVG_MOST = 32, 5 << 20

#: Styles that hide an element that has text (pattern, technique).
ELEMENT_STYLES = [
    (r"display\s*:\s*none", "display: none"),
    (r"visibility\s*:\s*hidden", "visibility: hidden"),
    (r"opacity\s*:\s*0(?:[;\s]|$)", "opacity: 0"),
    (r"font-size\s*:\s*[0-1](?:\.[0-9]+)?px", "Microscopic font-size"),
    (r"color\s*:\s*(?:white|#fff(?:fff)?|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))\s*;?.*background(?:-color)?\s*:\s*(?:white|#fff(?:fff)?|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))", "White text on white background"),
    (r"color\s*:\s*(?:transparent|rgba\(\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*0\s*\))", "Transparent text"),
    (r"position\s*:\s*absolute.*(?:left|top)\s*:\s*-[0-9]{3,}", "Off-screen positioning"),
    (r"text-indent\s*:\s*-[0-9]{3,}", "text-indent off-screen"),
    (r"overflow\s*:\s*hidden.*(?:width|height)\s*:\s*0", "Zero-size overflow hidden"),
]

#: Hosts of images (with all below them), hosts of user content (themselves only), and trusted hosts (with all below them).
IMAGE_HOSTS = "raw.githubusercontent.com user-images.githubusercontent.com camo.githubusercontent.com gist.githubusercontent.com img.shields.io images.unsplash.com i.imgur.com upload.wikimedia.org cdn.jsdelivr.net unpkg.com placehold.co placeholder.com placekitten.com i.ytimg.com img.youtube.com cdn.discordapp.com media.discordapp.net pbs.twimg.com images.zenn.dev qiita-image-store.s3.amazonaws.com qiita-user-contents.imgix.net cdn.qiita.com assets.st-note.com lh3.googleusercontent.com images.ctfassets.net mermaid.ink quickchart.io mdn-imagestore.mdn.mozilla.net embed-fastly.wistia.com media.licdn.com nostr.build".split()
CONTENT_HOSTS = "github.com gist.github.com imgur.com wikipedia.org wikimedia.org unsplash.com notion.so youtube.com developer.mozilla.org qiita.com zenn.dev".split()
TRUSTED_HOSTS = "google-analytics.com googletagmanager.com analytics.google.com stats.g.doubleclick.net doubleclick.net mixpanel.com segment.io segment.com amplitude.com hotjar.com hubspot.com klaviyo.com marketo.com bing.com fbcdn.net stripe.com auth0.com okta.com twilio.com sendgrid.net mailgun.org postmarkapp.com intercom.com intercomcdn.com zendesk.com salesforce.com atlassian.com jsdelivr.net unpkg.com cdnjs.cloudflare.com imagekit.io imgix.net cloudinary.com githubassets.com npmjs.com pypi.org rubygems.org crates.io packagist.org gravatar.com office.com office.net outlook.com vimeocdn.com".split()

#: Limits of encoded payloads, and characters that make a decoded one multi-layered.
BASE64_SIZES, HEX_SIZES, ENTITY_CAP, PUNYCODE_CAP, PAYLOAD_CAP = (20, 8192), (40, 16384), 4096, 64, 256
LAYER_CLASS = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}"

#: Structured text: limits, tags that run code, phrases, keys and fields.
FIELD_MOST, FIELD_DEPTH, FIELD_ANCHORS, FIELD_CAP = 1 << 20, 12, 128, 32
YAML_TAGS = ["!!python/object/apply", "!!python/object/new", "!!python/object", "!!python/name", "!!python/module", "!!js/function", "!!js/regexp", "!!js/undefined", "!ruby/object", "!ruby/hash", "!!exec", "!!new"]
FIELD_PHRASES = [
    r"\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"\bdisregard\s+(?:all\s+)?(?:previous|prior|above)\b",
    r"\b(?:you\s+are|act\s+as|pretend\s+to\s+be|roleplay\s+as)\s+(?:now\s+)?a\b",
    r"\bsystem\s*[:|]\s*you\s+are\b",
    r"\b(?:override|forget|delete)\s+(?:all\s+)?(?:previous|prior|your)\s+(?:instructions?|prompts?)\b",
    r"\b(?:reveal|leak|exfiltrate|print|output)\s+(?:the\s+)?(?:system\s+)?prompt\b",
    r"\bnew\s+instructions?\s*[:|]",
]
FIELD_KEYS = ["system-prompt", "system_prompt", "inject-prompt", "inject_prompt", "override-instructions", "override_instructions", "ignore-previous", "ignore_previous", "ignore_prior_instructions"]
JSONLD_FIELDS = ["description", "name", "articleBody", "headline", "abstract", "text"]

#: Names of control characters, and labels of invisible ones in masked texts.
CONTROL_NAMES = dict(zip([*range(9), 11, 12, *range(14, 32), *range(0x7F, 0xA0)], "NULL SOH STX ETX EOT ENQ ACK BEL BS VT FF SO SI DLE DC1 DC2 DC3 DC4 NAK SYN ETB CAN EM SUB ESC FS GS RS US DEL PAD HOP BPH NBH IND NEL SSA ESA HTS HTJ VTS PLD PLU RI SS2 SS3 DCS PU1 PU2 STS CCH MW SPA EPA SOS SGCI SCI CSI ST OSC PM APC".split(), strict=True))
MASK_LABELS = {0xAD: "SHY", 0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x2060: "WJ", 0xFEFF: "BOM", 0x180E: "MVS", 0x2028: "LSEP", 0x2029: "PSEP", 0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI"}
BIDI_NAMES = {0x202A: "Left-to-Right Embedding (LRE)", 0x202B: "Right-to-Left Embedding (RLE)", 0x202C: "Pop Directional Formatting (PDF)", 0x202D: "Left-to-Right Override (LRO)", 0x202E: "Right-to-Left Override (RLO)", 0x2066: "Left-to-Right Isolate (LRI)", 0x2067: "Right-to-Left Isolate (RLI)", 0x2068: "First Strong Isolate (FSI)", 0x2069: "Pop Directional Isolate (PDI)"}
INVISIBLE_NAMES = {0x200B: "Zero-Width Space", 0x200C: "Zero-Width Non-Joiner", 0x200D: "Zero-Width Joiner", 0x2060: "Word Joiner", 0xFEFF: "Zero-Width No-Break Space (BOM)", 0x200E: "Left-to-Right Mark", 0x200F: "Right-to-Left Mark", 0x206A: "Inhibit Symmetric Swapping", 0x206B: "Activate Symmetric Swapping", 0x206C: "Inhibit Arabic Form Shaping", 0x206D: "Activate Arabic Form Shaping", 0x206E: "National Digit Shapes", 0x206F: "Nominal Digit Shapes", 0xAD: "Soft Hyphen", 0x180E: "Mongolian Vowel Separator", 0x202F: "Narrow No-Break Space", 0x205F: "Medium Mathematical Space", 0x3000: "Ideographic Space", 0x3164: "Hangul Filler", 0x115F: "Hangul Choseong Filler", 0x1160: "Hangul Jungseong Filler"}

#: Descriptions of tools: hidden instructions (pattern, flags), invisible signal, Cyrillic look-alikes.
TOOL_RULES = [
    (r"\bignore\s+(?:all\s+)?previous\s+(?:instructions?|rules?|prompts?)\b", "i"),
    (r"\bdisregard\s+(?:all\s+)?previous\s+(?:instructions?|rules?)\b", "i"),
    (r"^[\s>*-]*system\s*:\s*(?:you\s+are|act\s+as|never|always)", "im"),
    (r"^[\s>*-]*assistant\s*:\s*(?:you\s+are|never|always)", "im"),
    (r"\bdeveloper\s+mode\b", "i"),
    (r"<\|im_start\|>\s*(?:system|user|assistant)", "i"),
    (r"<\|start_header_id\|>\s*(?:system|user|assistant)\s*<\|end_header_id\|>", "i"),
    (r"\bnew\s+(?:system|safety)\s+prompt\b", "i"),
    (r"\boverride\s+(?:safety|guard|policy)", "i"),
]
TOOL_SIGNAL = r"\x{E0000}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200F}\x{FEFF}"
TOOL_CYRILLIC = "аеорсхуиӏ"

#: Priorities.
BASE_PRIORITY = {"danger": 70, "warning": 35, "info": 10, "safe": 5}
BUCKET_WEIGHT = {"hiddenHtml": 1.20, "bidiOverride": 1.20, "suspiciousPatterns": 1.10, "invisibleUnicode": 1.05, "homoglyphs": 1.00, "controlChars": 0.95}
BUCKETS = ["invisibleUnicode", "controlChars", "hiddenHtml", "suspiciousPatterns", "homoglyphs"]

#: White space of the rules' dialect.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _spaces(rule: str) -> str:
    out, inside, i = "", False, 0
    while i < len(rule):
        two = rule[i : i + 2]
        if two == r"\s":
            out += SPACE if inside else f"[{SPACE}]"
        elif two == r"\S" and not inside:
            out += f"[^{SPACE}]"
        elif two[0] == "\\":
            out += two
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out += two[0]
            i -= 1
        i += 2
    return out


def pattern(rule: str, flags: str = "i", engine: str = "java") -> str:
    """A rule in the dialect of Spark (java), DuckDB (re2) or Python (py), with equal meaning.

    White space is one explicit class, also inside a bracket expression, a dot stops at line ends, word edges are ASCII.
    """
    out = _spaces(rule).replace(".*", r"[^\n\r\x{2028}\x{2029}]*")
    if engine != "re2" and r"\b" in out:
        out = out.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    if engine == "py":
        import re

        out = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", out).replace(r"\z", r"\Z")
        return f"(?a{flags})" + out
    return (f"(?{flags})" if flags else "") + out


def linear(k: int, engine: str = "java") -> tuple[str, str]:
    """The pattern that finds the hits of a phrase rule in linear time, and the test of a match ("" for none)."""
    _, rule, flags, _ = PHRASE_RULES[k]
    if k not in LINEAR:
        return pattern(rule, flags, engine), ""
    find, test = LINEAR[k]
    return pattern(find, flags, engine), test and pattern(test, flags, engine)
