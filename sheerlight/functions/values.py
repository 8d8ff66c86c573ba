"""Values that must equal those of the scanner whose results are to be met."""

from __future__ import annotations

# Severities, from the worst on.
SEVERITIES = ("high", "medium", "low")

# Invisible code points, their names and severities.
INVISIBLE = {
    0x200B: ("ZERO WIDTH SPACE", "medium"),
    0x200C: ("ZERO WIDTH NON-JOINER", "low"),
    0x200D: ("ZERO WIDTH JOINER", "low"),
    0x2060: ("WORD JOINER", "medium"),
    0xFEFF: ("ZERO WIDTH NO-BREAK SPACE (BOM)", "medium"),
    0x00AD: ("SOFT HYPHEN", "low"),
    0x061C: ("ARABIC LETTER MARK", "low"),
    0x180E: ("MONGOLIAN VOWEL SEPARATOR", "medium"),
    0x2028: ("LINE SEPARATOR", "low"),
    0x2029: ("PARAGRAPH SEPARATOR", "low"),
    0x202A: ("LEFT-TO-RIGHT EMBEDDING", "high"),
    0x202B: ("RIGHT-TO-LEFT EMBEDDING", "high"),
    0x202C: ("POP DIRECTIONAL FORMATTING", "high"),
    0x202D: ("LEFT-TO-RIGHT OVERRIDE", "high"),
    0x202E: ("RIGHT-TO-LEFT OVERRIDE", "high"),
    0x2066: ("LEFT-TO-RIGHT ISOLATE", "high"),
    0x2067: ("RIGHT-TO-LEFT ISOLATE", "high"),
    0x2068: ("FIRST STRONG ISOLATE", "high"),
    0x2069: ("POP DIRECTIONAL ISOLATE", "high"),
}
TAG_NAME = "UNICODE TAG (ASCII smuggling)"

# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = {0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x", 0x0456: "i", 0x03BF: "o", 0x03B1: "a", 0x03C1: "p", 0x03C7: "x", 0x03BA: "k"}

# First code points of styled alphabets of 26 letters, capitals and small ones.
STYLED_UPPER = (0x1D400, 0x1D434, 0x1D468, 0x1D504, 0x1D5A0, 0x1D608, 0x1D670, 0xFF21, 0x1F1E6)
STYLED_LOWER = (0x1D41A, 0x1D44E, 0x1D482, 0x1D51E, 0x1D4B6, 0x1D5BA, 0x1D622, 0x1D68A, 0xFF41)

# Signs dropped between letters.
DELIMITERS = "|_`^~"

# Words recognised with their inner letters scrambled.
SCRAMBLED = (
    "ignore bypass override reveal delete system previous instructions disable remove enable activate disregard follow obey comply "
    "pretend assume imagine prompt filter safety access admin developer repeat explain forget display output print never jailbreak"
).split()

# Instruction phrases.  A blank is white space, ~ white space or nothing, < and > the edges of an ASCII word.
INSTRUCTIONS = {
    "IP01": "<ignore (?:all )?(?:previous|prior|above) (?:instructions|prompts?)>",
    "IP02": "<disregard (?:the )?(?:previous|above|system)>",
    "IP03": "<you are now>",
    "IP04": "<new instructions?~:",
    "IP05": "{line}~(?:system|assistant|user|human|ai)~:",
    "IP06": "<do not (?:tell|inform|mention to) the user>",
    "IP07": "<forget (?:all )?(?:previous|prior|earlier) (?:instructions|context|prompts?)>",
    "IP08": "<override (?:your|the) (?:instructions|programming|guidelines|rules)>",
    "IP09": "<pretend (?:to be|you~(?:'re|are))>",
    "IP10": "<roleplay as>",
    "IP11": "<developer mode>",
    "IP12": "<do anything now>",
    "IP13": "<jailbreak(?:ing)? (?:the )?(?:model|ai|assistant|chatbot|llm)>",
    "IP14": "<from now on~,?~(?:you|your)>",
    "IP15": "<your new role is>",
    "IP16": "<(?:reveal|show|print|output|display) your (?:system prompt|instructions|initial prompt)>",
    "IP17": "<ignor(?:ing|es|ed) (?:all )?(?:previous|prior|above) (?:instructions?|prompts?|context)>",
    "IP18": "<disregard(?:ing|ed)? all (?:the )?(?:previous|prior|above|earlier)>",
    "IP19": "<never (?:say|tell|respond|answer) (?:me )?(?:you )?(?:can't|cannot|can not)>",
    "IP20": "<(?:explain|repeat|reveal|output) (?:me )?(?:all )?(?:the )?(?:previous|prior|above) (?:instructions?|prompts?|context)>",
    "IP21": "<hypothetically{after}",
    "IP22": "<fetch (?:[A-Za-z0-9_]+ )?(?:from|at) {solid}+\\.{solid}+",
    "IP23": "<as an? ethical (?:hacker|researcher|pentester)>",
    "IP24": "<(?:give|tell|show|send|reveal|provide) (?:me )?(?:the )?(?:your )?system prompt>",
    "IP25": "\U0001f6ab (?:all )?(?:previous|prior|above) (?:instructions?|prompts?|context)>",
    "IP26": "<repeat (?:the )?(?:text|words?) above verbatim>",
    "IP27": "<print your (?:initial )?instructions? word for word>",
    "IP28": "<encode your (?:instructions?|system prompt) (?:in|as) base~64>",
    "IP29": "<let's (?:think|reason|work) (?:step by step|through this)>",
    "IP30": "<(?:think|reason) step by step>",
    "IP31": "<think carefully~[,;:.!?]",
    "IP32": "<take a deep breath and (?:think|reason|work|solve|answer|respond|approach)>",
    "IP33": "---~(?:BEGIN|START) (?:INSTRUCTIONS?|PROMPT|OVERRIDE|RULES|SYSTEM)~---",
    "IP34": "---~(?:END|STOP) (?:INSTRUCTIONS?|PROMPT|OVERRIDE|RULES|SYSTEM)~---",
}

# Phrases with their letters spaced out.
SPACED = {
    "SP01": "<i g n o r e (?:a l l )?(?:p r e v i o u s|p r i o r|a b o v e) (?:i n s t r u c t i o n s?|p r o m p t s?)>",
    "SP02": "<d i s r e g a r d (?:a l l )?(?:t h e )?(?:p r e v i o u s|p r i o r|a b o v e|e a r l i e r|s y s t e m)>",
    "SP03": "<n e v e r (?:s a y|t e l l|r e s p o n d|a n s w e r) (?:m e )?(?:y o u )?(?:c a n (?:'|n o t)|c a n n o t)>",
}

# Control tokens of chat templates.  A point stands for one blank here.
CONTROL_TOKENS = {"CT1": r"<\|im_start\|>", "CT2": r"<\|im_end\|>", "CT3": r"</system>", "CT4": r"\[INST\]", "CT5": r"\[/INST\]", "CT6": r"---{any}END OF PROMPT{any}---"}

# Limits.
BASE64_LEAST = 24
RUN_LEAST = 6
COMBINING_LEAST = 8
BITS_LEAST = 8
READABLE_LEAST = 6
READABLE_SHARE = 0.85
JWT_WINDOW = 500
ATTRIBUTE_LEAST = 20
SAMPLE_CUT, DECODED_CUT, MATCH_CUT, CONTEXT_CUT = 32, 120, 80, 90
PAGE_CAP = 200
FOLD_LEAST = 5

# Classes that mark text for screen readers; elements whose text is not read.
A11Y_CLASSES = ("sr-only", "visually-hidden", "offscreen", "screen-reader-text")
SKIP_TAGS = ("SCRIPT", "STYLE", "NOSCRIPT", "TEMPLATE")
ATTRIBUTES = ("aria-label", "title")

# Colours by severity.
COLOURS = {"high": "#e5484d", "medium": "#f5a623", "low": "#3b82f6"}

# What types with a decoded text are called, and the sentences for pages without findings and for those that can't be scanned.
DECODED_LABELS = {
    "encoded-percent": "Percent-encoded blob",
    "encoded-hex-escape": "Hex-escaped blob",
    "encoded-spaced-hex": "Space-separated hex byte blob",
    "encoded-unicode-escape": "\\uXXXX-escaped blob",
    "encoded-html-entity": "HTML-entity-encoded blob",
    "variation-selector-smuggling": "Hidden variation-selector payload",
    "sneaky-bits-smuggling": "Hidden invisible-bit-encoded payload",
}
NOTHING = "No hidden content or injection markers found."
CANNOT = "Can't scan this page."

# The words of the other labels.
TAG_LABEL, TAG_DECODED = "Invisible ASCII-smuggling character", " → decodes to: "
INVISIBLE_LABEL, BASE64_LABEL, JWT_LABEL, TOKEN_LABEL = "Invisible character: ", "Encoded blob", " (looks like a JWT)", "LLM chat-template control token: "
HIDDEN_LABEL, A11Y_LABEL = "Visually hidden text (", " — looks like accessibility markup, downgraded"
PHRASE_LABEL, REVEALED_LABEL = "Instruction-like phrase", " (revealed after removing invisible characters)"
MARKS_LABEL, MARKS_END = "Excessive combining diacritical marks (", " marks on one character)"
COMMENT_LABEL = " (in an HTML comment)"
