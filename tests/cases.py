"""Pattern cases as data: (pattern, subject, texts of all matches)."""

ALL = [
    # atoms and escapes
    (r"\x4a\x{4B}L", "xJKLx", ["JKL"]),
    (r"\112\0", "J\0", ["J\0"]),
    (r"\t\v\n\r\f\a\e", "\t\x0b\n\r\x0c\x07\x1b", ["\t\x0b\n\r\x0c\x07\x1b"]),
    (r"\cB\C-b", "\x02\x02", ["\x02\x02"]),
    (r"\M-A", "\xc1", ["\xc1"]),
    (r"a.c", "abc a\nc a\rc", ["abc", "a\rc"]),
    (r"\.\*\+", ".*+", [".*+"]),
    (r"[.]\-", "a.-", [".-"]),
    (r"\R", "a b\tc", [" ", "\t"]),
    # shorthands and properties
    (r"\w+", "naïve_x 9½ -", ["naïve_x", "9½"]),
    (r"(?a)\w+", "naïve", ["na", "ve"]),
    (r"\d+", "1²3 Ⅳ x", ["1²3", "Ⅳ"]),
    (r"(?a)\d+", "1²3", ["1", "3"]),
    (r"\s", "a\xa0b c", [" "]),
    (r"\h+", "fg0G", ["f", "0"]),
    (r"\p{Lu}\P{Lu}", "aBcD", ["Bc"]),
    (r"\p{^L}", "a1", ["1"]),
    (r"\p{Title case Letter}", "ǅa", ["ǅ"]),
    (r"\p{digit}", "1²", ["1"]),
    (r"\p{sc=Grek}+", "aαβ", ["αβ"]),
    (r"\p{scx=Kana}", "ーa", ["ー"]),
    (r"\p{Cyrillic}", "АA", ["А"]),
    (r"\p{Any}", "x", ["x"]),
    # classes
    (r"[]a]+", "]a", ["]a"]),
    (r"[^]a]", "]ab", ["b"]),
    (r"[a-]+", "-a", ["-a"]),
    (r"[\d-x]+", "1-x", ["1-x"]),
    (r"[a\b]", "\x08", ["\x08"]),
    (r"[\101-\103]+", "ABCD", ["ABC"]),
    (r"[[:alpha:][:digit:]]+", "aé1_", ["aé1"]),
    (r"[[:^space:]]+", "ab cd", ["ab", "cd"]),
    (r"[a-z&&[^m-p]&&[^x]]+", "almx", ["al"]),
    (r"[^a-y&&b-z]+", "bz", ["z"]),
    (r"[[a-c][^\x00-w]]+", "bwz", ["b", "z"]),
    # anchors
    (r"^.", "a\nb\n", ["a", "b"]),
    (r"^", "a\n", ["", ""]),
    (r".$", "a\nb\r\n", ["a", "\r"]),
    (r"\Aa|b\z", "ab", ["a", "b"]),
    (r"a\Z", "a\n", ["a"]),
    (r"a\Z", "a\n\n", []),
    (r"\bé\b", "é éa", ["é"]),
    (r"\B.", "ab", ["b"]),
    (r"\Ga", "aaba", ["a", "a"]),
    (r"a\Kb", "abab", ["b", "b"]),
    # quantifiers
    (r"a{2}", "aaaaa", ["aa", "aa"]),
    (r"a{,2}b", "aaab", ["aab"]),
    (r"a{2,}?", "aaaa", ["aa", "aa"]),
    (r"x{}y{,}z{a}", "x{}y{,}z{a}", ["x{}y{,}z{a}"]),
    (r"a**", "aa*", ["aa*"]),
    (r"*a", "*a", ["*a"]),
    (r"a*", "xax", ["", "a", "", ""]),
    (r"a*?", "aa", ["", "", ""]),
    (r"a++a", "aaa", []),
    (r"(?:ab|a)++b", "ab", ["ab"]),
    (r"a{1,2}+a", "aaa", ["aaa"]),
    (r"(?:a|ab)*c", "ababc", ["ababc"]),
    # groups
    (r"(?>a|ab)c", "abc", []),
    (r"a(?#note)b", "ab", ["ab"]),
    (r"(?i:a)b", "AbAB", ["Ab"]),
    (r"a(?i)b|c", "aBC", ["aB", "C"]),
    (r"(?x) a  b # c", "ab", ["ab"]),
    (r"(?i-i:a)(?-i)b", "ab", ["ab"]),
    (r"\d+(?=%)", "10% 20", ["10"]),
    (r"\b\d+\b(?!%)", "10% 20", ["20"]),
    (r"(?<=[$€])\d+", "$1 €22 3", ["1", "22"]),
    (r"(?<!\d)\d", "12 3", ["1", "3"]),
    (r"(?<=a+b*)c", "aabbc bc", ["c"]),
    (r"(?~ab)", "xxabyy", ["xxa", "byy", ""]),
    (r"/\*(?~\*/)\*/", "/*a*/b/**/", ["/*a*/", "/**/"]),
    (r"(<)?x(?(1)>|!)", "<x> x!", ["<x>", "x!"]),
    (r"(?<q>['\"])?x(?(<q>)\k<q>|;)", "'x' x;", ["'x'", "x;"]),
    # references and calls
    (r"(.)\1", "aabcc", ["aa", "cc"]),
    (r"(?<n>a)(?<n>b)\k<n>", "abb", ["abb"]),
    (r"(a)|b\1", "ba", ["a"]),
    (r"(?i)(ß)\1", "ßSS", ["ßSS"]),
    (r"\((?:[^()]|\g<0>)*\)", "(a(b)c) (", ["(a(b)c)"]),
    (r"(?<p>\[\g<p>*\])", "[[][]] [", ["[[][]]"]),
    # case folding
    (r"(?i)strasse", "Straße STRASSE", ["Straße", "STRASSE"]),
    (r"(?i)k[ſ]", "Ks KS", ["Ks", "KS"]),
    (r"(?i)[^ß]", "ssx", ["s", "x"]),
    (r"(?i)ﬁ", "FI fi ﬁ", ["FI", "fi", "ﬁ"]),
    (r"(?i)[ß]+", "sSßs", ["sSß"]),
    # order of alternatives
    (r"a|ab", "ab", ["a"]),
    (r"|a", "a", ["", ""]),
    (r"foo|bar|baz", "bazfoo", ["baz", "foo"]),
]

GROUPS = [
    # (pattern, subject, groups of the first match)
    (r"(a)|(b)", "b", [None, "b"]),
    (r"(a*)(b)?", "aa", ["aa", None]),
    (r"(?:(a*))*", "aa", [""]),
    (r"(?:(a)|b)*", "ab", ["a"]),
    (r"(?<=(a+)b)c", "aabc", ["aa"]),
    (r"(?=(\w+))\w", "abc", ["abc"]),
    (r"(?!(a))b", "b", [None]),
    (r"(?<y>\d+)-(\d+)", "2024-05", ["2024", "05"]),
    (r"(?>(a+))b", "aab", ["aa"]),
]

ERRORS = ["(", ")", "[a", "a\\", r"\p{Nope}", r"[\p{Nope}]", r"\p{Script=Klingon}", "(?(0)a)", r"\k<-1>", r"\k<x>", r"\g<2>(a)", "[z-a]", "a{3,2}", r"\x4", r"\u12", r"\x{110000}", r"\uD800", r"\08", "(?#a", "(?<n", "(?z)", r"(?<=(?~a))b", "[[:nope:]]", r"\k<0>", r"\k<+1>(a)", "(?(n)a)"]
