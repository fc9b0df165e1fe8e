"""Word lists that rules refer to, as data. Entries are regular expressions where they hold signs."""

#: Questions are routed to the first scope of which a term occurs; terms of the second list must be whole words.
SCOPE_TERMS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "personal": (("工资", "年薪", "薪水"), ("my salary", "my income", "my earnings", "do i earn", "am i paid")),
    "stock": (("股票", "股价", "财报", "市值", "估值", "期权", "持仓"), ("stocks?", "share price", "earnings", "ticker")),
    "technical": (
        ("代码", "源码", "仓库", "项目", "编程", "架构", "检索", "算法", "报错"),
        ("api", "architecture", "code", "debug", "github", "java", "python", "rag", "repository", "sqlite", "system design"),
    ),
    "history": (("历史备份", "旧备份", "备份档案"), ("historical backup", "old backup", "archived backup")),
}
#: What stands before a name in book-title marks, and before a quoted one.
NAMED_BEFORE_TITLE = ("档案", "文件", "资料")
NAMED_BEFORE_QUOTE = ("record", "document", "file")

#: Labels of credentials, prefixes of keys that need no label, and words that make a login of what stands near.
CREDENTIAL_LABELS = ("password", "passwd", "pwd", "secret", "token", "api[_-]?key", "accesskey", "密码", "口令", "密钥")
KEY_PREFIXES = ("sk-", "AKID", "AKIA", "LTAI")
LOGIN_WORDS = ("账号", "账户", "凭据", "账密", "认证", "password", "credential", "auth")
URL_SCHEMES = ("http", "https", "ws", "wss", "ftp", "file")

CONDITIONS = ("如果", "假如", "假设", "若", "一旦")
ADVERSATIVES = ("但是?", "不过", "然而")
#: After one of these a bare pair of numbers is a range of prices, not a date.
PRICE_LEADS = ("入", "入场", "损", "止损", "站上", "价", "价格", "区间", "参考")
