"""These must equal the published ones for results to agree."""

# --- Fixed values: enums -----------------------------------------------------------------
SOURCES = ("google_maps", "ptt", "dcard")
CONTENT_TYPES = ("review", "post", "comment")
SENTIMENTS = ("positive", "neutral", "negative", "rating_only", "unknown")
PRECISIONS = ("day", "week", "month", "year", "unknown")
NO_CHANNEL = "未提供頻道"
UNTITLED_THREAD = "未命名討論串"
UNNAMED_TOPIC = "待命名抱怨"
UNNAMED = "未命名"
LOCAL_OFFSET_HOURS = 8

# --- Fixed values: which date precisions a bucket accepts --------------------------------
ACCEPTED_PRECISION = {
    "day": ("day",),
    "week": ("day", "week"),
    "month": ("day", "week", "month"),
}
MAX_TREND_DAYS = 366 * 30

# --- Fixed values: aspect codes and labels -----------------------------------------------
ASPECT_LABELS = {
    "product_quality": "產品／品質",
    "service": "服務",
    "price_value": "價格／價值",
    "environment": "環境",
    "speed_wait": "效率／等候",
    "convenience_accessibility": "便利／可及性",
    "brand_reputation": "品牌聲譽",
    "marketing_communication": "行銷／溝通",
    "workplace": "職場／雇主",
    "trust_safety": "信任／安全",
    "other": "其他",
}
NO_ASPECT_LABEL = "尚無足夠面向資料"

# --- Fixed values: metric whitelists -----------------------------------------------------
METRIC_KEYS = (
    "reply_count",
    "comment_count",
    "like_count",
    "push_count",
    "boo_count",
    "reaction_count",
    "floor",
)
SIGNALS = ("push", "boo", "neutral")
DIAGNOSTIC_COUNTERS = (
    "pages_fetched",
    "articles_fetched",
    "missing_articles",
    "unparsed_articles",
    "filtered_articles",
    "search_pages",
    "article_requests",
    "unavailable_articles",
    "duplicate_items",
    "unknown_date_items",
    "search_urls_found",
    "import_thread_count",
)
PARTIAL_REASONS = (
    "post_limit",
    "page_limit",
    "pagination_cycle",
    "thread_comment_limit",
    "comment_limit",
    "article_unavailable",
    "article_parse_partial",
    "public_page_partial",
    "public_search_partial",
    "public_source_blocked",
    "public_source_unavailable",
    "source_unavailable",
    "unknown_date",
    "invalid_url",
)
COLLECTION_SCOPES = ("public_html", "import_only")

# --- Fixed values: masks and their patterns ----------------------------------------------
# W is "a Unicode letter, digit or underscore"; texts are whitespace-collapsed before masking.
W = r"\p{L}\p{N}_"
MASK_URL = ("[網址已遮罩]", r"(?i)(?:https?://|www\.)[^ ]+")
MASK_EMAIL = ("[電子郵件已遮罩]", rf"(?<![{W}.+-])[{W}.+-]+@[{W}-]+(?:\.[{W}-]+)+")
MASK_PHONE = (
    "[電話已遮罩]",
    r"(?<!\p{Nd})(?:\+?886[- ]?)?(?:0?9\p{Nd}{2}|0\p{Nd}{1,2})[- ]?\p{Nd}{3,4}[- ]?\p{Nd}{3,4}(?!\p{Nd})",
)
MASK_HANDLE = ("[帳號已遮罩]", rf"(?<![{W}])@[A-Za-z0-9_.-]{{2,}}")
MASK_LONG_ID = ("[識別碼已遮罩]", r"(?<!\p{Nd})\p{Nd}{8,}(?!\p{Nd})")
MASKS = {
    "url": MASK_URL,
    "email": MASK_EMAIL,
    "phone": MASK_PHONE,
    "handle": MASK_HANDLE,
    "long_id": MASK_LONG_ID,
}
MODEL_FORBIDDEN_KEYS = (
    "author",
    "author_hash",
    "author_name",
    "source_url",
    "maps_url",
    "address",
    "board",
    "forum",
    "business",
    "subject",
    "aliases",
)

# --- Fixed values: word lists ------------------------------------------------------------
STOPWORDS = (
    "這個 那個 我們 你們 他們 自己 就是 但是 因為 所以 然後 可以 一個 沒有 還是 已經 真的 非常 的 了 和 是 在 有 "
    "the and for this that with https http www com"
).split()
DOMAIN_TERMS = (
    "麵包 麵條 牛肉麵 小籠包 鼎泰豐 春水堂 餐廳 餐點 餐具 餐飲 飲料 飲品 服務 服務員 店員 態度 環境 衛生 衛生紙 清潔 "
    "廁所 乾淨 髒亂 美味 好吃 難吃 等候 排隊 等待 出餐 效率 速度 價格 價位 昂貴 便宜 份量 品質 食材 新鮮 口味 口感 "
    "湯頭 咖啡 珍珠 奶茶 珍珠奶茶 外帶 內用 外送 訂位 預約 菜單 結帳 結賬 買單 停車 交通 位置 分店 商家 店家 品牌 "
    "推薦 再訪 回訪 冷氣 空調 吵雜 客人 顧客 抱怨 改善 優點 缺點"
).split()
TOKENIZER_VERSION = "letter-runs+best-path-v3"
CLUSTER_STOPWORDS = ("這個", "真的", "但是", "覺得")
POSITIVE_WORDS = (
    "好吃",
    "推薦",
    "親切",
    "滿意",
    "優秀",
    "乾淨",
    "方便",
    "love",
    "great",
    "excellent",
    "friendly",
    "recommend",
)
NEGATIVE_WORDS = (
    "難吃",
    "失望",
    "糟糕",
    "態度差",
    "太慢",
    "髒",
    "不推薦",
    "terrible",
    "bad",
    "slow",
    "rude",
    "disappointed",
)
LEXICON_MODEL = "heuristic-fallback"
VOTE_MODEL = "ptt-signal-rule"
CONTEXT_SUFFIX = "+tw-context-v1"

# --- Fixed values: phrase groups of the calibration --------------------------------------
POSITIVE_PHRASES = (
    r"(?<!不)(?:好吃|好喝|美味|過癮|涮嘴|推薦|值得|滿意|親切|新鮮|讚)",
    r"(?:會|想|值得)(?:再來|回訪)|下次還會",
    r"吃(?:了|超過)?\s*\d+\s*年|從.{1,12}開始到現在|老顧客|老主顧",
    r"love|great|excellent|friendly|recommend",
)
NEGATIVE_PHRASES = (
    r"難吃|踩雷|雷店|失望|糟糕|退步|變差|態度差|不推薦",
    r"沒滋沒味|沒味道|不入味|太淡|死鹹|太鹹|太油|油膩|不新鮮",
    r"不是(?:炒飯|蛋包飯|麵|湯)|醬油拌飯|像在吃白飯|只是白飯",
    r"等(?:了|超過)?.{0,8}(?:分鐘|小時)|太慢|漏單|送錯|沒熟|異物",
    r"terrible|bad|slow|rude|disappointed|never again",
)
PHRASE_WEIGHT = 0.62
STAR_PRIOR = {
    5: ("positive", 0.52),
    4: ("positive", 0.34),
    3: ("neutral", 0.18),
    2: ("negative", 0.34),
    1: ("negative", 0.52),
}

# --- Fixed values: relative-date grammar -------------------------------------------------
RELATIVE_EN = r"(\d+|a|an)\s+(minute|hour|day|week|month|year)s?\s+ago"
RELATIVE_ZH = r"(\d+|一|幾)\s*(?:個)?(分鐘|小時|天|週|周|星期|月|年)前"
RELATIVE_NOW = ("just now", "剛剛", "分鐘前")
UNIT_MINUTES = {
    "minute": 1,
    "分鐘": 1,
    "hour": 60,
    "小時": 60,
    "day": 1440,
    "天": 1440,
    "week": 10080,
    "週": 10080,
    "周": 10080,
    "星期": 10080,
    "month": 43200,
    "月": 43200,
    "year": 525600,
    "年": 525600,
}
UNIT_PRECISION = {
    "minute": "day",
    "分鐘": "day",
    "hour": "day",
    "小時": "day",
    "day": "day",
    "天": "day",
    "week": "week",
    "週": "week",
    "周": "week",
    "星期": "week",
    "month": "month",
    "月": "month",
    "year": "year",
    "年": "year",
}

# --- Fixed values: bulk-import layout and limits -----------------------------------------
IMPORT_FIELDS = (
    "item_type",
    "source_item_id",
    "thread_id",
    "parent_id",
    "title",
    "text",
    "published_at",
    "forum",
    "source_url",
    "author",
    "reaction_count",
)
FORUM_HOST = "www.dcard.tw"
BOARD_HOST = "www.ptt.cc"
TRACKING_FIELDS = ("cid", "ref", "referrer", "source", "share", "fbclid", "gclid")
MAP_HOSTS = ("google.com", "google.com.tw")
MAP_SHORT_HOSTS = ("goo.gl", "maps.app.goo.gl")
BLOCK_MARKERS = (
    "access denied",
    "service temporarily unavailable",
    "just a moment...",
    "verify you are human",
    "系統負荷過重",
)
MORE_COMMENT_MARKERS = ("View more comments", "查看更多留言", "載入更多留言")
NO_RESULT_MARKERS = (
    "沒有搜尋結果",
    "找不到符合的結果",
    "沒有更多結果",
    "No results found",
    "No more results",
)
NEXT_LABELS = ("next", "next page", "下一頁", "下頁", "›", "»")
DELETED_TEXTS = ("[deleted]", "[removed]", "(本文已被刪除)", "此則留言已被刪除", "此留言已被刪除")
DELETED_COMMENTS = ("(本文已被刪除)", "[deleted]")
BODY_SKIP_PREFIXES = (">", "※ 發信站", "※ 文章網址", "※ 編輯", "※ 來自")
VOTE_SIGNALS = {"推": "push", "噓": "boo", "→": "neutral"}
ADDRESS_TOKENS = ("路", "街", "巷", "號", "區", "Road", "Street", "Ave")

# --- Fixed values: stop-reason priorities ------------------------------------------------
BOARD_STOP_ORDER = (
    "pagination_cycle",
    "page_limit",
    "article_parse_partial",
    "article_unavailable",
    "thread_comment_limit",
    "comment_limit",
    "post_limit",
)
FORUM_STOP_ORDER = (
    "source_unavailable",
    "unknown_date",
    "public_page_partial",
    "page_limit",
    "public_search_partial",
    "thread_comment_limit",
    "comment_limit",
    "post_limit",
)

# --- Fixed values: sampling, retrieval and rule limits -----------------------------------
EVIDENCE_LIMIT = 60
EVIDENCE_CHARS = 800
EXCERPT_CHARS = 300
RETRIEVAL_LIMIT = 20
HISTORY_LIMIT = 8
PACK_ITEMS = 40
PACK_CHARS = 60_000
DEFAULT_WEEKLY_HOURS = 5.0
CLUSTER_JOIN = 0.80
TOPIC_MATCH = 0.90
TOPIC_MARGIN = 0.05
TOPIC_VERSION = "centroid-v1"
CHUNK_TOKENS = 510
CHUNK_STRIDE = 448
JOURNEYS = {
    "campus": ("查詢資訊", "詢問／申請", "等待處理", "取得服務", "後續申訴", "未能判定"),
    "business": ("搜尋資訊", "詢問／預約", "購買", "使用", "售後", "未能判定"),
}
VERDICT_LABELS = {
    "INSUFFICIENT": "資料不足",
    "OBSERVING": "觀察中",
    "REVIEW": "需人工判讀",
    "MET": "達到預設目標",
    "NOT_MET": "未達預設目標",
}
