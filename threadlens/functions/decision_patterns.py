"""The patterns that decide what counts as a decision, in RE2 notation (see regexes.java)."""

# Their wording decides results.
STRONG_CUE = r"(?i)\b(?:decide|decision|choose|chose|choice|select|selected|prefer|preferred|recommend|recommendation|should we|we['’]?ll use|we will use|let['’]?s use|adopt|go with|pick|trade[- ]off|instead of|rather than)\b|决定|决策|选择|选用|偏好|推荐|建议|采用|取舍|替代|代替|改用|不要.*改|不使用"
USAGE_CUE = r"(?i)\buse\b|使用"
SEMANTIC_USAGE = r"(?i)\b(?:because|since|due to|instead of|rather than|over|choose|pick|select|prefer|recommend|adopt|trade[- ]off|option|alternative|approach|proposal)\b|因为|由于|而非|而不是|替代|选择|考虑|方案|取舍|推荐|建议|采用|改用"
CONFIRM = r"(?i)^\s*(?:(?:yes|yep|yeah|correct|right|looks good|sounds good|good|great|perfect|approved|accept(?:ed)?|ship it|proceed|go ahead|do that|that works|works for me|please do|done|thanks|thank you)\b\s*[.!?,;:]?|(?:可以|好的|好吧|正确|对的|没问题|看起来不错|批准|通过|确认|继续|就这样|按这个|搞定|谢谢)(?:\s*[，,。.!！?？:：;；]|$)|(?:采用|发布)\s+[^.!?\n。！？]{1,120}(?:[.!?\n。！？]|$))"
IMPLEMENT = r"(?i)\b(?:implemented|built|added|created|completed|fixed|shipped|deployed|merged)\b|(?:实现了|已实现|完成了|已经完成|修复了|已修复|已合并|已发布|部署完成)"
NOT_DONE = r"(?i)\b(?:not|never|didn['’]?t|doesn['’]?t|isn['’]?t|is not|wasn['’]?t|was not)\s+(?:implemented|built|added|created|completed|fixed|shipped|deployed|merged)\b|(?:未实现|没有实现|尚未完成|未完成|没有修复|尚未修复)"
TEST = r"(?i)(?:\b(?:go test|cargo test|pytest|npm test|yarn test|pnpm test|vitest|jest|gradle test|mvn test)\b[^\n]*(?:pass|passed|ok|success|green)\b)|(?:\btests?\b[^\n]*(?:pass|passed|ok|success|green)\b)|(?:测试(?:全部|都)?通过)|(?:^|\n)\s*(?:ok|PASS)\b"
TEST_FAIL = r"(?i)(?:\b(?:go test|cargo test|pytest|npm test|yarn test|pnpm test|vitest|jest|gradle test|mvn test)\b[^\n]*(?:fail|failed|failure|error|panic|did not pass|does not pass|doesn['’]?t pass)\b)|(?:\btests?\b[^\n]*(?:fail|failed|failure|error|panic|did not pass|does not pass|doesn['’]?t pass)\b)|(?:测试失败|测试报错|build failed)|(?:^|\n)\s*FAIL\b"
BECAUSE = r"(?is)\b(?:because|since|so that|due to)\s+(.+?)(?:[.!?]|$)|(?:因为|由于|为了)\s*(.+?)(?:[。！？!?]|$)"
PURPOSE = r"(?is)(?:便于|方便|避免|确保|以便|适合|符合|有利于|保证|防止|减少|降低|支持)\s*(.+?)(?:[.!?]|$|[。！？!?])"
CONSEQUENCE_BEFORE = r"(?is)^(.+?)[，,；;]\s*(?:therefore|so|thus|因此|所以)\s*((?:(?:i|we|我|我们|主路径)\s*)?(?:(?:switch(?:ed)?\s+to|use|choose|chose|select(?:ed)?|recommend(?:ed)?|adopt(?:ed)?|go\s+with)\b|(?:改用|换成|改为|转为|切换到|采用|使用|选择|推荐|建议)(?:了)?).+?)(?:[.!?。！？]|$)"
CONSEQUENCE_AFTER = r"(?is)[，,；;]\s*(?:so|therefore|thus|这样|因此|所以)\s*(.+?)(?:[.!?]|$|[。！？!?])"
CONSEQUENCE_CHOICE = r"(?is)(?:(?:switch(?:ed)?\s+to|use|choose|chose|select(?:ed)?|recommend(?:ed)?|adopt(?:ed)?|go\s+with)\b\s+|(?:改用|换成|改为|转为|切换到|采用|使用|选择|推荐|建议)(?:了)?\s*)(.+)$"
CHOICE_REASON = r"(?i)\b(?:because|since|due to|so that|so|therefore|thus)\b|因为|由于|为了|便于|方便|避免|确保|以便|适合|符合|有利于|保证|防止|减少|降低|支持|这样|因此|所以"
REJECTED_TAIL = r"(?i)\s*(?:(?:[,;，；]\s*)?(?:do not use|don't use|not use|instead of|rather than)\b|(?:[,;，；]\s*)?(?:不使用|不用|而非|而不是))"
DESCRIPTOR_TAIL = r"(?i)\s+(?:as\s+(?:the\s+)?|作为)(?:[^,，;；]{0,40})$"
TRAILING_CLAUSE = r"[,，;；]\s*(?:because|since|due to|so that)\b|[,，;；]\s*(?:因为|由于|为了|避免|便于|确保)"
CHOICE_SEPARATOR = r"(?i)\s+(?:or|或者)\s+|或者|、|\s+/\s+"
INSTEAD = r"(?is)\binstead of\s+(.+?)(?:,|;|\s+(?:use|choose|pick|adopt|go with)\s+)(.+?)(?:[.!?]|$)|(?:不使用|不要)\s*(.+?)(?:(?:，|,|；|;)\s*(?:改用|换成|改为|使用)|\s+(?:改用|换成|改为))\s*(.+?)(?:[。！？!?]|$)"
CHOOSE_OVER = r"(?is)\b(?:choose|pick|select|prefer|use|adopt|go with)\b\s+(.+?)\s+(?:over|rather than|instead of)\s+(.+?)(?:\s+because\b|[.!?]|$)"
COMPARISON = r"(?is)^\s*(?:(?:我|我们)\s*)?(?:(?:建议|推荐)(?:使用|用)?|使用|采用|选择|改用)\s*([^\n。！？]{1,120}?)\s*[,，]?\s*(?:不使用|不用|而非|而不是)\s*([^\n。！？]{1,120})|^\s*([^.!?\n，。！？]{1,120}?)\s+(?:而非|而不是)\s+([^.!?\n，。！？]{1,120})"
USE = r"(?is)(?:we['’]?ll use|we will use|let['’]?s use|recommend(?:ation)?|adopt|go with|choose|pick|select|^\s*(?:[-*+] |\d+[.)]\s+)?use|采用|改用|使用|选择|建议|推荐)\s+([^.!?\n，。！？]{1,120})"
LEADING_USE = r"(?is)^\s*use\s+([^.!?\n，。！？]{1,120})"
NEGATIVE_USE = r"(?is)^\s*(?:do not|don't|never|not|without)\s+use\b|\b(?:do not|don't|never|not)\s+use\b|^\s*(?:不要|不使用|未使用|没有使用|尚未使用)"
PROGRESS_NOISE = r"(?i)\b(?:i['’]?m|i am)\s+(?:pulling|reading|checking|inspecting|reviewing|verifying|confirming|comparing|collecting|gathering|looking(?:\s+at)?)\b|\bi\s+want\s+to\s+be\s+precise\b|(?:我|我们)(?:正在|在)(?:拉取|读取|检查|核对|审查|验证|确认|比较|收集|查看)"
QUESTION_WORDS = r"(?i)\b(?:should we|which|what should|how should we)\b|是否|哪个方案|怎么选|如何选择"
NOISE_TAG = r"(?is)<\/?(?:skill|subagent_notification|external_agent_tool_call|environment_context|proposed_plan|system(?:-reminder)?|user_info|developer(?:_context)?)\b|\[/?(?:external_agent_tool_call|subagent_notification|bash-(?:stdout|stderr))\]"
#: Messages that match one of these, or NOISE_TAG, are left out as a whole.
XML_NOISE = r"(?is)<(?:environment_context|system(?:-reminder)?|user_info|developer(?:_context)?|instructions?)\b"
AGENTS_NOISE = r"(?im)(?:^|\n)\s*(?:#\s*)?(?:AGENTS(?:\.md)?|system instructions?|developer instructions?|ignore previous|you are an ai)\b"
LOOP_EVENT_NOISE = r"(?is)^\s*(?:tool[._-](?:call|result)\b|<tool(?:[ ._:-]|>)|\[/?tool(?:[ ._:-]|>))"
PROMPT = r"(?i)\b(?:only give|return only|output only|do not modify|don't modify|just answer|please inspect|key files?|focus on|must list|expected outcome|task|automation|context from my ide setup|system instructions?|developer instructions?)\b|只给|只返回|只接受|不要修改|请重点检查|关键文件|已验证|输出格式|任务|自动化|上下文"
CHOICE_LABEL = r"(?i)\b(?:approved|changes_requested|pass|fail|yes|no)\s*(?:or|/|、|或)\s*\b(?:approved|changes_requested|pass|fail|yes|no)\b"
PLAN = r"(?i)\b(?:next step|next|then|after that|later|i['’]?ll|i will|we['’]?ll|we will|going to|plan to|intend to|let me|todo|to do|first .* then)\b|下一步|接下来|然后|之后|稍后|我会|我们会|计划|打算|先.*再|待办"
FUTURE_PLAN = r"(?i)^\s*(?:(?:i|we)(?:['’]?ll|\s+will)|going to|plan to|intend to)\b|^\s*(?:将|即将|准备|接下来|下一步|后续|稍后|我会|我们会|我将|我们将|计划|打算)|^\s*(?:现在|接下来)\s*(?:改|修改|调整|补|新增|实现|写|处理|做|停掉|准备)|^\s*先.+再|\bnext step\b|下一步"
META = r"(?i)\b(?:i need to decide|i should decide|i['’]?m deciding|let me decide|thinking through|reasoning about|need to choose|we need to decide)\b|我(?:需要|应该)决定|我在(?:判断|考虑)|需要选择"
DELIBERATION = r"(?i)\b(?:i['’]?m considering|i am considering|i might|i wonder|let me try|let me go with|could use|might be best)\b"
REFUSAL = r"(?i)\b(?:i can['’]?t|cannot|can not|won['’]?t|not able|unable|not permitted|must refuse|refuse to|i['’]?m not allowed)\b|不能|无法|不可以|不允许|拒绝|没法"
OPEN_QUESTION = r"(?i)[?？]|\b(?:is this correct|is that right|does this look right|can we use this)\b|(?:正确吗|对吗|是否正确|可以吗|行吗|是真的吗)"
PROGRESS = r"(?i)\b(?:i['’]?m|i am)\s+(?:pulling|reading|checking|inspecting|reviewing|verifying|confirming|comparing|collecting|gathering|looking(?:\s+at)?)\b|\bi\s+want\s+to\s+be\s+precise\b|\b(?:i['’]?m|i am)\s+using\b[^.!?\n]{0,80}\bskill\b"
NEGATIVE = r"(?i)\b(?:do not|don't|never|not|without)\s+use\b|^\s*(?:不要(?:使用|把)?|不使用|不用|未使用|没有使用|尚未使用)\b|\b(?:不会|并非|不是)\b[^。！？!?\n]{0,40}\b(?:使用|采用|选择)\b"
REPLACEMENT = r"(?i)\b(?:instead of|rather than)\b|[,;，；]\s*(?:(?:do not|don't|not)\s+use|use|choose|pick|adopt|go with)\b|\b(?:改用|换成|改为|转为|切换到|不使用|不用|而非|而不是)\b"
STATUS = r"(?i)^\s*(?:done|completed|implemented|built|added|created|fixed|shipped|deployed|merged|passed|approved|changes_requested|approved with risks)\b|已完成|完成了|已实现|已修复|已合并|通过|批准|搞定"
PREDICATE = r"(?i)\b(?:choose|chose|selected|select|prefer|preferred|recommend|recommended|adopt|go with|pick|we chose|we selected|we prefer|we recommend|we adopted|instead of|rather than|over)\b|选择|选用|偏好|推荐|建议|采用|取舍|替代|代替|改用|而非|而不是"
EXPLICIT_CHOICE = r"(?i)\b(?:choose|chose|selected|select|prefer|preferred|recommend|recommended|adopt|go with|pick|use|we chose|we selected|we prefer|we recommend|we adopted)\b|选择|选用|偏好|推荐|建议|采用|使用|改用|更推荐|优先使用"
BULLET = r"(?m)^\s{0,3}(?:[-*+] |\d+[.)]\s+)"
HEADING = r"(?s)^\s*(?:\*\*|__)[^\n]+(?:\*\*|__)\s*$"
TABLE = r"(?m)^\s*\|.*\|"
ASCII_TOKEN, CJK_TOKEN = r"[A-Za-z][A-Za-z0-9_+-]{2,}", r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{2,}"
#: Tokens that say nothing about the matter; shorter ones than LEAST_TOKEN do neither.
GENERIC_TOKENS = ["the", "and", "for", "with", "from", "that", "this", "use", "used", "using", "will", "would", "should", "because", "instead", "rather", "than", "implemented", "implementation", "tests", "test", "passed", "pass", "success", "green"]
LEAST_TOKEN, LEAST_SEGMENT, LEAST_QUOTE, CHOICE_CHARS = 4, 8, 8, 120
CHOICE_EDGES = "`\"'“”‘’()[]{}:：,，;；"
CONFIRM_WITHIN, IMPLEMENT_WITHIN, ADMITTED_FROM = 3, 4, 0.62

# What is too general, or a clause and no name, to be a choice.
GENERIC_CHOICE_PREFIX = r"(?i)^(?:a|an|the|this|that|it|one|some|any|no|not)\s+"
GENERIC_CHOICE = r"(?i)^(?:a|an|the|this|that|it|one|case|path|option|choice|solution|approach|method|way|prefix|thing|something|anything|nothing|no|not|不再|http|https?|json|api|url|token|response|request|data|annotation)$|^(?:this|that|the)\s+(?:path|option|choice|case|way)$|^(?:这个|那个|此|该)?(?:路径|方案|选项|选择|用例|案例)$"
CHOICE_CLAUSE = r"(?i)\b(?:because|since|due to|so that|could|might|should|would|will|can|want|need|try|using|use|uses|is|are|was|were|be|returns?|resolves?|passes?|fails?|missing|required?|rather|instead|while|which|that)\b|(?:因为|由于|为了|可保留|或改|等(?:工具|方式|方法|流程|技能)|而且|但是|因此|所以|以及|而|但)"
CHOICE_PRONOUN = r"(?i)^(?:it|this|that|these|those|them|they|he|she|we|you|me|us)(?:\s+(?:up|down|out|in|on|off|over|there|here))?$"
TOOL_META_CHOICE = r"(?i)\bskills?\b|技能"
USABLE_CHOICE_CHARS, RELATED_WITHIN = 80, 2
