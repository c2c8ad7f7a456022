"""The patterns and words that decide what counts as noise, a label, an option or an answer.

They are Java regular expressions. WS is white space as Python's str.strip sees it, which Java's \\s leaves out in part.
"""

WS = r"[\s\x1C-\x1F]"
FLAGS = "(?U)"

# Line boundaries, and marks at an option.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: What any line break has.
BREAKS = LINE_BREAK.removeprefix("\r\n|")
OPTION_END = "[.、．)）:：]"

# Buttons and captions of the pages that texts are taken from.
CHROME_WORDS = ["查看试卷", "查看答案", "查看解析", "随机选择", "返回列表", "上一题", "下一题", "答题卡", "提交试卷", "开始考试", "考试时长", "剩余时间", "我的试卷", "错题回顾", "冲！", "冲!"]
# Names of question kinds in section headings.
KIND_WORDS = ["单选题", "多选题", "判断题", "是非题", "填空题", "简答题", "问答题", "选择题", "不定项选择题"]
# Words before an answer, an explanation and a stem.
ANSWER_WORDS = ["正确答案", "参考答案", "正确选项", "标准答案", "答案", "answer"]
EXPLANATION_WORDS = ["答案解析", "解析", "说明"]
LABEL_WORDS = ["题目", "问题", "题干", "问"]
ASK_WORDS = ["Q", "问", "问题", "题目"]
REPLY_WORDS = ["A", "答", *ANSWER_WORDS]
# Fixed value: a phrase that any question may have ("which of the following statements is wrong").
PHRASE = "(?:下列|以下|下述|关于|对于)?(?:说法|选项|行为|内容|表述|叙述|做法|观点)(?:中|里)?(?:错误|正确|不正确|不恰当|不当|有误)的?(?:是|有|包括|为)?"
#: The first characters of the words that every such phrase has.
MAYBE_PHRASE = "[说选行内表叙做观]"


def one_of(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


SCORE_MARK = rf"[\[（(]{WS}*\d+{WS}*分{WS}*[\]）)]"
CHROME = f"{FLAGS}{one_of(CHROME_WORDS)}{WS}*"
SECTION = f"{FLAGS}(?:^|{WS})[一二三四五六七八九十]+{WS}*[、.．]{WS}*{one_of(KIND_WORDS)}{WS}*"
NUMBER_WITHIN = rf"{FLAGS}(?:^|{WS})(?:第{WS}*)?\d{{1,4}}{WS}*[、.．)）]{WS}*{SCORE_MARK}{WS}*"
LEADING_NUMBER = rf"{FLAGS}^(?:第{WS}*\d{{1,4}}{WS}*题|[（(\[]?\d{{1,3}}[）)\].、:：,，]){WS}*"
LEADING_SCORE = f"{FLAGS}^{SCORE_MARK}{WS}*"
#: What begins a line that LEADING_NUMBER or LEADING_SCORE changes, and the characters without which no noise can be: digits, those
#: that begin a caption, and the end of all kinds of question.
LEADING = rf"{LEADING_NUMBER}|{LEADING_SCORE}"
MAYBE_NOISE = rf"{FLAGS}[\d题{''.join(sorted({w[0] for w in CHROME_WORDS}))}]"
HEADER_LINE = rf"{FLAGS}^{WS}*(?:第{WS}*)?\d{{1,4}}{WS}*[、.．)）]{WS}*(?:{SCORE_MARK})?{WS}*$"
LABEL = f"{FLAGS}^{one_of(LABEL_WORDS)}{WS}*[：:]{WS}*"
OPTION_LINE = f"{FLAGS}(?s)^([A-Ha-h]){WS}*{OPTION_END}{WS}*(.+)$"
UPPER_OPTION_LINE = f"{FLAGS}(?s)^[A-H]{WS}*{OPTION_END}{WS}*.+$"
OPTION_MARK = f"{FLAGS}(?:^|(?<={WS}))([A-H]){WS}*{OPTION_END}{WS}*"
ANSWER_PART = f"{FLAGS}(?is){one_of(ANSWER_WORDS)}{WS}*[：:]{WS}*(.+)$"
EXPLANATION_LINE = f"{FLAGS}(?s)^{one_of(EXPLANATION_WORDS)}{WS}*[：:]{WS}*(.+)$"
ASK_LINE = f"{FLAGS}(?is)^{one_of(ASK_WORDS)}{WS}*[：:]{WS}*(.+)$"
REPLY_LINE = f"{FLAGS}(?is)^{one_of(REPLY_WORDS)}{WS}*[：:]{WS}*(.+)$"
LETTER_ANSWER = rf"{FLAGS}^(?:[A-H、，,;；/|]|{WS})+$"
# What is trimmed from an option within a line, between pasted options, and between texts of an answer.
OPTION_TRIM = "^[ \t、,，;；]+|[ \t、,，;；]+$"
OPTION_SEPARATOR = "[|｜\n]"
ANSWER_JOIN = " / "

# Names of the kinds of match and the reasons why an answer can't be given as letters.
EXACT, FRAGMENT, CONTAINED, CLOSE = "完全相同", "片段包含", "被包含", "近似"
NOT_FOUND = "题库无此题"
INCOMPLETE = "题库里这道题的选项不完整"
NO_TEXT = "题库里这道题没有可用的答案原文"
NO_OPTIONS = "你只给了题干没给选项，无法校对顺序"
MISSING_BEFORE, MISSING_AFTER = "你给的选项里找不到「", "」"

# The words around what a person reads of an answer, and the length of a normal stem below which options are listed.
SHOWN_ANSWER, SHOWN_TEXTS, SHOWN_EXPLANATION, ARROW = "答案: ", "选项原文: ", "\n  解析: ", "  → "
TURNED_BEFORE, TURNED_AFTER = "   （题库里存的是 ", "，说明这次选项顺序不同，已按你看到的顺序重算）"
NO_LETTERS_BEFORE, NO_LETTERS_AFTER = "\n      !! 无法确定字母：", "——请按上面的选项原文作答"
SHORT_NOTE, SHORT_SHOWN = "\n      题干过短，可能是通用题干，核对选项是否一致: ", 15
SESSION = "本轮 对 {} / 错 {}"
# Characters of a stem and of an answer's text that a list of pairs shows.
STEM_SHOWN, TEXT_SHOWN = 66, 58
