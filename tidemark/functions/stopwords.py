"""Words that neither refine a query nor belong in a phrase. Fixed values."""

PHRASE_STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "i", "in", "is", "it", "its", "my", "of", "on", "or", "our", "so", "that", "the", "their", "this",
    "to", "was", "we", "were", "with", "you", "your", "just", "very", "really", "about", "what", "when", "how", "why", "not", "no", "do", "does", "did", "can", "will", "would", "should",
    "could", "http", "https", "www", "com",
)
FOREIGN = (
    "de", "del", "el", "la", "las", "los", "lo", "y", "en", "un", "una", "por", "para", "es", "le", "les", "des", "du", "et", "une", "au", "aux", "est", "sur", "der", "das", "und", "mit", "von",
    "zu", "ist", "ein", "eine", "het", "een", "van", "voor", "op", "il", "di", "che", "per", "em", "os", "uma", "dos", "nas", "nos", "como", "está", "esta", "todo", "muy", "pero", "más", "que",
    "qué", "se", "su", "al", "mi", "son", "hay", "ya", "con", "não", "mas", "muito",
)
BACKGROUND = (
    "actually", "add", "another", "best", "between", "both", "doing", "don", "down", "enough", "first", "free", "goes", "having", "instead", "little", "local", "long", "love", "making",
    "off", "old", "order", "probably", "products", "real", "right", "save", "stop", "sure", "through", "two", "until", "using", "where", "while", "work", "worth", "year",
)
GENERAL = (
    "about", "after", "again", "ago", "all", "also", "any", "anyone", "anything", "back", "because", "been", "before", "being", "come", "day", "dont", "even", "ever", "every", "everyone",
    "everything", "feel", "get", "getting", "give", "go", "going", "good", "got", "great", "had", "he", "her", "here", "heres", "him", "his", "if", "im", "into", "know", "let", "like",
    "literally", "lol", "look", "made", "make", "many", "more", "most", "much", "need", "never", "new", "now", "one", "only", "other", "out", "over", "own", "people", "said", "same", "say",
    "see", "she", "some", "someone", "something", "still", "take", "than", "thank", "thanks", "them", "then", "there", "these", "they", "thing", "things", "think", "those", "time", "today",
    "too", "try", "tried", "up", "us", "use", "used", "via", "want", "way", "well", "which", "who", "yeah", "yes",
)
JAPANESE = (
    "一緒", "世界", "気持", "今日", "昨日", "明日", "今年", "去年", "最近", "今回", "前回", "本当",
    "自分", "感じ", "美味", "時間", "毎日", "一番", "全部", "大好", "普通", "結構", "今度",
)
#: What breaks a phrase, and what says nothing as a term.
BREAKS = tuple(dict.fromkeys((*PHRASE_STOPS, *FOREIGN, *BACKGROUND, *GENERAL)))
EVERY = (*BREAKS, *JAPANESE)
