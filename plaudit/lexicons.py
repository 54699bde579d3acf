"""Word lists, patterns and label sets.

FIXED VALUES: everything in this module must equal the values the original
review analyser uses, otherwise scores and labels differ. They are listed
plainly, in their original order (order matters where the first listed match
wins, e.g. aspect context). Matching is substring containment on lower-cased
text unless a function says otherwise.
"""

# --- FIXED VALUES: sentiment intensity (weights +2, +1, -2, -1) ---
INTENSITY_VERY_POSITIVE = ["excellent", "amazing", "love", "perfect", "fantastic",
                           "太棒", "太好", "非常好", "完美", "喜欢"]
INTENSITY_POSITIVE = ["good", "nice", "fun", "enjoy", "great",
                      "不错", "还可以", "有趣", "不做"]
INTENSITY_VERY_NEGATIVE = ["terrible", "horrible", "hate", "worst", "awful",
                           "太差", "很差", "讨厌", "垃圾"]
INTENSITY_NEGATIVE = ["bad", "boring", "issue", "problem", "disappointing",
                      "不好", "一般", "问题"]

# --- FIXED VALUES: issue categories for detect_issues ---
ISSUE_CATEGORIES = {
    "Performance": ["lag", "fps", "slow", "crash", "freeze", "卡顿", "延迟", "崩溃"],
    "Graphics": ["graphics", "texture", "resolution", "graphics card", "画面", "贴图"],
    "Gameplay": ["gameplay", "balance", "mechanic", "control", "游戏平衡", "机制"],
    "Story/Content": ["story", "plot", "mission", "content", "故事", "情节"],
    "Audio": ["sound", "audio", "music", "voice", "声音", "音乐"],
    "Network/Multiplayer": ["server", "lag", "multiplayer", "connection", "服务器", "联网"],
    "Bugs/Glitches": ["bug", "glitch", "error", "broken", "漏洞", "错误"],
    "DLC/Pricing": ["price", "expensive", "dlc", "pay", "价格", "昂贵"],
}

# --- FIXED VALUES: aspects (order inside a list matters for the context window) ---
ASPECTS = {
    "gameplay": ["gameplay", "mechanic", "control", "combat", "puzzle", "level", "difficulty",
                 "fun", "玩法", "机制", "操作", "关卡", "难度"],
    "graphics": ["graphics", "graphic", "visual", "art", "texture", "model", "effect",
                 "画面", "画质", "美术", "特效", "图形"],
    "audio": ["sound", "music", "bgm", "voice", "audio", "音效", "音乐", "配音", "声音"],
    "story": ["story", "narrative", "plot", "character", "lore", "剧情", "故事", "角色", "叙事"],
    "performance": ["performance", "fps", "frame", "lag", "bug", "crash", "optimization",
                    "性能", "帧率", "优化", "bug"],
    "price": ["price", "cost", "expensive", "cheap", "worth", "value", "free",
              "价格", "性价比", "值", "贵"],
    "server": ["server", "online", "multiplayer", "connection", "latency", "ping",
               "服务器", "网络", "延迟", "联机"],
    "community": ["community", "player", "toxic", "hacker", "cheater", "玩家", "社区", "外挂", "脚本"],
    "content": ["content", "update", "dlc", "map", "mode", "quantity", "content",
                "内容", "更新", "dlc", "模式"],
    "support": ["support", "customer", "response", "developer", "客服", "开发商", "售后", "响应"],
}

# --- FIXED VALUES: fallback lexicon sentiment ---
LEXICON_POSITIVE = ["good", "great", "excellent", "amazing", "love", "best", "awesome",
                    "fantastic", "perfect", "fun", "好", "棒", "赞", "喜欢", "优秀"]
LEXICON_NEGATIVE = ["bad", "terrible", "awful", "worst", "hate", "boring", "bug", "crash",
                    "lag", "垃圾", "差", "烂", "无聊"]

# --- FIXED VALUES: topic keywords (matched on cleaned text) ---
TOPIC_KEYWORDS = {
    "Gameplay & Mechanics": ["gameplay", "mechanic", "control", "balance", "difficulty",
                             "游戏", "机制", "难度", "平衡"],
    "Graphics & Visual": ["graphics", "visual", "graphics card", "resolution", "texture",
                          "画面", "画质", "分辨率", "贴图"],
    "Performance & Tech": ["performance", "lag", "fps", "crash", "bug", "glitch",
                           "性能", "卡顿", "帧率", "崩溃", "漏洞"],
    "Story & Content": ["story", "plot", "narrative", "character", "mission", "quest",
                        "故事", "剧情", "任务", "角色"],
    "Sound & Music": ["sound", "audio", "music", "voice", "voice act", "声音", "音乐", "配音"],
    "Multiplayer & Online": ["multiplayer", "online", "pvp", "co-op", "server", "多人", "联网", "服务器"],
    "Price & Value": ["price", "expensive", "worth", "value", "dlc", "money", "价格", "值得", "花费", "金钱"],
    "Learning Curve": ["difficulty", "learning", "complex", "intuitive", "beginner",
                       "难度", "学习", "复杂", "新手"],
    "Replayability": ["replay", "replay value", "content length", "grinding", "重玩", "内容", "时长"],
    "Community & Support": ["community", "support", "developer", "update", "mod", "社区", "更新", "开发者"],
}

# --- FIXED VALUES: topic sentiment keywords (regex alternation on raw lower text) ---
TOPIC_SENTIMENT_KEYWORDS = {
    "Gameplay": ["gameplay", "mechanic", "control", "游戏", "机制"],
    "Graphics": ["graphics", "visual", "画面", "画质"],
    "Performance": ["lag", "fps", "crash", "卡顿", "崩溃"],
    "Story": ["story", "plot", "故事", "剧情"],
    "Price": ["price", "expensive", "价格", "昂贵"],
}

# --- FIXED VALUES: English stop words of the keyword extractor ---
STOP_WORDS_EN = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
                 "by", "from", "is", "are", "was", "be", "been", "being", "i", "you", "he", "she",
                 "it", "we", "they", "what", "which", "who", "this", "that", "these", "those", "my",
                 "your", "his", "her", "its", "just", "only", "not", "no", "can", "could", "would",
                 "should", "may", "might", "will", "have", "has", "had", "do", "does", "did", "get",
                 "got", "if", "then", "when", "where", "why", "how", "all", "each", "every", "about",
                 "so", "as", "game", "review", "play", "playing", "played"]

# --- FIXED VALUES: Chinese stop words of the keyword extractor ---
STOP_WORDS_ZH = ["的", "一", "是", "在", "不", "了", "有", "和", "人", "这", "中", "大", "为", "上",
                 "个", "国", "我", "以", "要", "他", "时", "来", "用", "们", "生", "到", "作", "地",
                 "于", "出", "就", "分", "对", "成", "会", "可", "主", "发", "年", "动", "同", "工",
                 "也", "能", "下", "现", "山", "民", "候", "经", "十", "反", "问", "很", "把", "她",
                 "只", "又", "多", "天", "比", "高", "自", "二", "而", "已", "其", "挺", "真", "游戏",
                 "玩", "好", "还"]

# --- FIXED VALUES: strong words (recommendation opinion intensity) ---
STRONG_WORDS_RECOMMEND = ["absolutely", "must", "never", "best", "worst", "always", "terrible",
                          "amazing", "excellent", "horrible", "perfect",
                          "完全", "绝对", "最好", "最差", "可怕", "优秀"]

# --- FIXED VALUES: strong words (benchmark sentiment intensity) ---
STRONG_WORDS_BENCHMARK = ["absolutely", "must", "never", "best", "worst", "terrible",
                          "amazing", "excellent", "horrible"]

# --- FIXED VALUES: benchmark issue groups (issue diversity) ---
BENCHMARK_ISSUES = {
    "performance": ["lag", "fps", "stutter", "slow", "performance"],
    "graphics": ["graphics", "visual", "texture", "render"],
    "gameplay": ["gameplay", "mechanics", "controls", "balance"],
    "audio": ["audio", "sound", "music", "voice"],
    "bugs": ["bug", "crash", "glitch", "error", "broken"],
    "story": ["story", "narrative", "plot", "character"],
}

# --- FIXED VALUES: benchmark dimensions, in report order ---
BENCHMARK_DIMENSIONS = ["positive_rate", "avg_quality_score", "issue_diversity",
                        "player_satisfaction", "review_engagement", "sentiment_intensity",
                        "topic_variety"]

# --- FIXED VALUES: version patterns (case-insensitive, capture group 1) ---
VERSION_PATTERNS = [r"v?(\d+\.\d+\.\d+)", r"version\s+(\d+\.\d+)", r"update\s+(\d+\.\d+)",
                    r"patch\s+(\d+\.\d+)", r"build\s+(\d+)", r"release\s+(\d{1,2}\.\d{1,2})",
                    r"(?:patch|update|hotfix).*?(\d+\.\d+)"]

# --- FIXED VALUES: update keywords ---
UPDATE_KEYWORDS_EN = ["update", "patch", "version", "release", "build", "hotfix",
                      "improvement", "fix", "added", "fixed", "new features", "changelog"]

# --- FIXED VALUES: quality detail words ---
QUALITY_DETAIL_WORDS = ["gameplay", "graphics", "performance", "story", "characters",
                        "游戏", "画面", "性能", "故事", "角色"]

# --- FIXED VALUES: playtime and length bins (left-closed) and their labels ---
PLAYTIME_BIN_EDGES = [0, 1, 5, 10, 20, 50, 100, 200, 500]
PLAYTIME_BIN_LABELS = ["<1h", "1-5h", "5-10h", "10-20h", "20-50h", "50-100h", "100-200h",
                       "200-500h"]
PLAYTIME_OVERFLOW_LABEL = ">=500h"
LENGTH_BIN_EDGES = [0, 50, 100, 200, 500, 1000]
LENGTH_BIN_LABELS = ["<50", "50-100", "100-200", "200-500", "500-1000", ">1000"]

# --- FIXED VALUES: segment labels ---
SEGMENTS = ["Enthusiasts", "Satisfied", "Cautious", "Dissatisfied", "Critical"]

# --- FIXED VALUES: recommendation weights ---
RECOMMEND_WEIGHTS = {"quality_score": 0.35, "helpfulness": 0.25, "sentiment_intensity": 0.15,
                     "recency": 0.15, "detail_level": 0.10}

# --- FIXED VALUES: language-code map (applied to the first five characters, lower-cased;
# anything else maps to "en"). The original sends "fr" to "de"; we keep "fr" -> "fr".
LANG_CODE_MAP = {"zh-cn": "zh", "zh-tw": "zh", "zh": "zh", "ja": "ja", "jp": "ja", "ko": "ko",
                 "kr": "ko", "es": "es", "fr": "fr", "de": "de", "ru": "ru", "pt": "pt",
                 "it": "it", "en": "en"}

# --- FIXED VALUES: default alert rules (name, condition, threshold, message) ---
DEFAULT_ALERT_RULES = [
    ("low_rating", "positive_rate_below", 0.5,
     "Warning: Positive rate ({rate:.1f}%) dropped below 50%"),
    ("negative_spike", "negative_reviews_spike", 2.0,
     "Warning: Negative reviews spike detected (recent: {recent}, avg: {avg:.1f})"),
    ("no_reviews", "total_reviews_below", 10.0,
     "Warning: Very few reviews collected ({total})"),
]
