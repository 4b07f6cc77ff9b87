"""Fixed values. Results depend on them being exactly these."""

# Punctuation words: tokens made of one of these are not words, and the
# one-character members are also deleted from inside words.
PUNCT_WORDS = [
    "", " ", '"', "\\", "\\\\", ",", "|?", "-", "--", "_", "*", "`", ":", ".", "/", ";", "'",
    "[", "]", "(", ")", "{", "}", "<", ">", "~", "^", "?", "&", "!", "=", "+", "#",
]

# Posting-client anchors and the plain word each one stands for.
CLIENT_ANCHORS = [
    ('<a href="http://instagram.com" rel="nofollow">Instagram</a>', "instagram"),
    ('<a href="http://twitter.com" rel="nofollow">Twitter Web Client</a>', "webclient"),
    ('<a href="http://www.twitter.com" rel="nofollow">Twitter for BlackBerry</a>', "blackberry"),
    ('<a href="http://twitter.com/#!/download/ipad" rel="nofollow">Twitter for iPad</a>', "ipad"),
    ('<a href="https://periscope.tv" rel="nofollow">Periscope.TV</a>', "tv"),
    ('<a href="https://about.twitter.com/products/tweetdeck" rel="nofollow">TweetDeck</a>', "webclient"),
    ('<a href="http://www.facebook.com/twitter" rel="nofollow">Facebook</a>', "facebook"),
]

# Mention counters: output column -> (name parts looked for inside words, exact handle).
MENTIONS = {
    "i_h_c": (["hillary", "clinton", "crooked"], "@HillaryClinton"),
    "i_b_o": (["obama", "barack"], "@BarackObama"),
}

# Column names of the post files and of the derived features.
TRAIN_COLUMNS = ["tweet_id", "user_handle", "tweet_text", "time_stamp", "device"]
TEST_COLUMNS = ["user_handle", "tweet_text", "time_stamp"]
COUNT_FEATURES = [
    "i_hash", "i_url", "i_tag", "i_capital", "i_punc", "i_terms", "puncs", "i_stopword",
    "i_h_c", "i_b_o", "i_hours", "i_days",
]

# Error types of the spelling channel.
ERROR_TYPES = ["deletion", "transposition", "substitution", "insertion"]

# Defaults of the sentence splitter: titles before a name, suffixes of companies and names, and words that
# show that a sentence begins after an abbreviation.
TITLES = ("mr", "mrs", "ms", "mx", "dr", "prof", "st", "mt", "rev", "hon", "gen", "sgt", "capt", "lt", "vs")
SUFFIXES = ("inc", "ltd", "corp", "co", "llc", "plc", "jr", "sr", "etc")
STARTERS = ("he", "she", "it", "they", "we", "i", "you", "the", "this", "that", "these", "but", "however", "our", "their")
