"""Character classes shared by every pattern, written for ``java.util.regex``.

Whitespace is spelled out because the Java ``\\s`` knows ASCII blanks only, and
word boundaries are spelled out because ``\\b`` treats Han letters as word
characters there.
"""

# The blanks a Unicode-aware text scanner strips and splits on.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# The common Han block, and a Chinese or Latin "name" character.
HAN = r"\u4e00-\u9fa5"
NAME_CHARS = HAN + r"A-Za-z0-9\u00b7\-"

# Line terminators that end a "rest of the line" match.
EOL = r"\n\r\u2028\u2029"

# One optional separator tolerated between the groups of a long number.
SEP = rf"[{WS}\-.\\/]?"

NOT_AFTER_DIGIT = r"(?<![0-9])"
NOT_BEFORE_DIGIT = r"(?![0-9])"
NOT_AFTER_WORD = r"(?<![0-9A-Za-z_])"
NOT_BEFORE_WORD = r"(?![0-9A-Za-z_])"
