"""Closed classes of words of the default script, as parameters of the name and cue operators."""

# All lists of this module must stand as they are for the same names and cues to be found.

#: Conjunctions, adverbs and predicate phrases that are no name.
FUNCTION_WORDS = """
倘若 如实 因为 所以 如果 那么 故此 继而 要知 倒不如 然而 虽然 唯有 只是 而是 并且 同时 可以 应该 任何 如此 这份 当年 如今 最终 率先 立马 立时 登时 陡然
好似 再度 兀自 主动 平淡 畅快 突兀 艰难 欣慰 果断 肆意 豪言 开怀 喜好 保证 打断 反驳 求情 安慰 破功 怒斥 娓娓 应和 低语 释然 肃然 傲然 昂然 娇嗔
这些 这种 那种 这样 那样 什么 怎么 就是 还是 但是 而且 然后 于是 因此 已经 曾经 正在 立刻 马上 终于 忽然 突然 当然 显然 其实 确实 简直 几乎 大概 也许
或者 不过 只有 还要 一边 一面 一声 一句 一手 一眼 一步 一阵 一番 一场 一时 一头 一起 一同 一直 一定 一样 一般 一切 一些 一点 一下
不知 不屑 就连 忍不住 颇有些 招呼 当先 打发 打听 打算 打量 应酬 寒暄 见礼 点头 摇头 挥手 抬手 伸手 转身 起身 抬头 低头 回首 回头 沉吟 迟疑 犹豫 叹息
叹气 苦笑 冷笑 微笑 大笑 冷哼 一字一句 毛遂自荐 指点江山 声音沙哑 神色僵硬 意兴阑珊 这两个字 这位婶娘 完全可以 好似是在 生怕自己 将两
见一 还有一 只有一 并且一 然而一 可这一 这样一 那样一
""".split()

#: Actions and postures that are no name as a whole.
ACTION_WORDS = """
拱手抱拳 躬身抱拳 躬身一礼 躬身拜 拱手执礼 拱手鞠躬 抱拳 鞠躬 拍掌 拍手称赞 拜见 叩首 诚心叩首 颔首 皱眉 闭目 咬着牙 冷着脸 满不在意 直接了当 轻松写意 喜极而泣 故作不知
故作可惜 故作调 连连保证 立马出列 开口道歉 开口询 上前询 接着询 仔细询 立即询 转而询 随即询 当即询
拱手 深吸 摇头 点头 上前 起身 转身 抬头 低头 回头 挥手 抬手 伸手 叹气 叹息 沉吟 皱眉 失笑 冷笑 微笑
""".split()

#: Titles that end a name.
TITLES = """
大师 禅师 师太 仙子 娘娘 先生 前辈 长老 掌门 真人 道人 首座 圣姑 教主 姑娘 夫人 公子 小姐 丫头 大爷 婆婆 姑姑 哥哥 姐姐 妹妹 兄弟 阁下 陛下 殿下 师兄
师弟 师姐 师妹 师父 师傅 老人 老者
""".split()

#: Characters that end no name.
BAD_FINAL = "的了着过但是而如果那么就还也都很太更最把被使让给对向从与或则乃依旧竟却已未不没非常更加话事人时后前中里外上下起身手眼口头声气意思情语笑掌拳躬拜别答一动完好象样点面边间处算加"

#: First characters of what is no name, by reason: prepositions, demonstratives, degrees, numerals.
PREP_PREFIX, DEMON_PREFIX, DEGREE_PREFIX, NUMERAL_PREFIX = "为被把让使给替由", "这那其此该某怎多么", "很挺更最极特超蛮", "一两"

#: Parts of the body and of the mind; what holds one describes an action.
BODY_CONTEXT = "脖子 脑袋 眼睛 嘴巴 手指 手臂 肩膀 胳膊 脸颊 额头 眉毛 鼻子 耳朵 心头 心中 心里 身上 脸上 手里 眼中 眼里 嘴里 脚下 眼下 背后 身边 面前 眼前".split()

#: Conjunctions and adverbs that begin what is no name.
FUNCTION_PREFIXES = """
虽然 因为 所以 倘若 如果 那么 于是 因此 然而 但是 而且 并且 同时 可以 应该 任何 如此 只是 只有 无论 不管 即使 即便 仍然 依然 忽然 突然 果然 当然 显然
其实 确实 简直 几乎 大概 也许 或者 不过 一旦 直到 随即 立刻 马上 终于 一直 再度 再次 十分 非常 尤其 渐渐 逐渐 勉强 不禁 顿时 登时 陡然 索性 干脆 偏偏
恰好 幸亏 幸好 好在 难道 不妨 除非 唯有 只要 万一 若是 假如 就算 哪怕 纵使 纵然 除了 关于 由于 为了 反而 反倒 甚至 不仅 不但 况且 何况 至于 从而 进而
""".split()

#: Interjections, and what each says about delivery; others say "interjection".
INTERJECTIONS = "哈哈 呵呵 嘿嘿 嘻嘻 哎呀 哎哟 咦 唉 嗯 哦 噢 嘿 喂 呸 哇 喔 呦 哼 嘁 切 啊 呀 哈 嘻 嘎 噗".split()
INTERJECTION_HINTS = {
    "哈哈": "amused", "呵呵": "sardonic", "嘿嘿": "sly", "嘻嘻": "amused", "哼": "sardonic", "唉": "weary", "哎呀": "surprised", "哎哟": "pained",
    "咦": "curious", "嗯": "assent", "哦": "realizing", "啊": "surprised", "哇": "admiring", "呸": "contemptuous",
}

#: Phrases and stems that say how something is said, and their hints in order: the first one inside a surface counts.
DELIVERY_PHRASES = """
饶有兴致 若有所思 意味深长 不动声色 不紧不慢 一字一顿 慢条斯理 兴致勃勃 似笑非笑 咬牙切齿 语重心长 漫不经心 心不在焉 不假思索
阴阳怪气 郑重其事 一本正经 小心翼翼 幸灾乐祸 无可奈何 气急败坏 眉开眼笑 愁眉苦脸 如释重负 不以为然 嗤之以鼻 恍然大悟 若有深意
""".split()
DELIVERY_STEMS = """
沉声 低声 轻声 厉声 高声 大声 小声 冷声 柔声 寒声 冷冷 淡淡 缓缓 徐徐 悠悠 幽幽 悻悻 狠狠 恨恨 愤愤 苦笑 冷笑 嗤笑 轻笑 微笑 干笑 狞笑 冷哼 怒哼
沉吟 迟疑 犹豫 兴奋 得意 尴尬 温柔 平静 认真 郑重 好奇 疑惑 惊讶 吃惊 叹息 叹气 咬牙 皱眉 点头 摇头 无奈 黯然 茫然 愕然 默然 欣然 坦然 恍然 悠然 漠然 淡然
""".split()
SAFE_STEMS = """
沉声 低声 轻声 厉声 高声 小声 冷声 柔声 冷冷 淡淡 缓缓 徐徐 悠悠 幽幽 悻悻 狠狠 苦笑 冷笑 轻笑 干笑 冷哼 沉吟 迟疑 犹豫
兴奋 得意 尴尬 温柔 平静 认真 郑重 好奇 疑惑 惊讶 吃惊 叹息 叹气 咬牙 皱眉 无奈 黯然 茫然 愕然 默然 欣然 坦然 恍然 悠然 漠然 淡然
""".split()
DELIVERY_HINTS = {
    "饶有兴致": "interested", "兴致勃勃": "interested", "好奇": "curious", "冷笑": "sardonic", "嗤笑": "sardonic", "似笑非笑": "sardonic", "阴阳怪气": "sardonic",
    "苦笑": "bitter", "无奈": "resigned", "无可奈何": "resigned", "如释重负": "relieved", "怒": "angry", "愤": "angry", "咬牙": "angry", "气急败坏": "angry", "咬牙切齿": "angry",
    "不耐烦": "impatient", "急切": "urgent", "急促": "urgent", "急忙": "urgent", "不悦": "annoyed", "不满": "annoyed", "不屑": "disdainful", "不以为然": "dismissive",
    "叹": "weary", "黯然": "sad", "悲": "sad", "愁": "sad", "惊讶": "surprised", "吃惊": "surprised", "愕然": "surprised",
    "疑惑": "uncertain", "迟疑": "uncertain", "犹豫": "uncertain", "茫然": "uncertain", "温柔": "gentle", "轻声": "gentle", "柔声": "gentle", "柔": "gentle",
    "郑重": "serious", "认真": "serious", "一本正经": "serious", "语重心长": "serious", "沉声": "grave", "厉声": "stern", "高声": "loud", "大声": "loud", "小声": "quiet",
    "低声": "quiet", "得意": "smug", "幸灾乐祸": "smug", "冷冷": "cold", "冷声": "cold", "寒": "cold", "淡漠": "cold", "漠然": "cold",
    "平静": "calm", "淡淡": "calm", "淡然": "calm", "坦然": "calm", "缓缓": "steady", "徐徐": "steady", "悠悠": "steady", "幽幽": "steady", "兴奋": "excited",
    "尴尬": "awkward", "心不在焉": "distracted", "若有所思": "thoughtful", "意味深长": "meaningful", "慢条斯理": "unhurried", "一字一顿": "emphatic",
}
VERB_HINTS = {"怒": "angry", "笑": "amused", "叹": "weary", "哭": "sad", "哼": "sardonic", "吼": "angry", "叫": "loud", "喊": "loud"}

#: Verbs of saying, compounds before their parts.
CUE_VERBS = """
开玩笑道 开玩笑说 追问道 反问道 补充道 解释道 提醒道 感慨道 感叹道 抱怨道 嘟囔道 附和道 赞同道 出声道 应声道 接着说 继续说道 笑着说 哭着说 摇头道 点头道 沉着脸道 大笑道 微笑着
低声道 厉声道 沉声道 淡淡道 冷冷道 说道 答道 问道 喊道 应道 回道 叫道 怒道 笑道 哭道 叹道 开口 回答 说 问 答 喊 叫 嚷 喝 道
""".split()
#: What stands before or after a single verb that is a cry, not a cue.
CRY_BEFORE, CRY_AFTER = "惨惊尖狂吼痛", "一声 起来 出声 着说".split()
#: Pronouns, and words for people without a name.
NO_NAME = """
没有 什么 这样 那样 不是 就是 自己 怎么 我们 你们 他们 这里 那里 这个 那个 时候 现在 已经 还是 或者 一直 忽然 他说 她说 我说 你说 他 她 我 你 大家 众人 她们
老人 女子 男子 青年 少年 姑娘 小伙子 大汉 壮汉 汉子 老者 女人 男人 小孩 孩子 仆人 丫鬟 下人 侍卫 管家 客人 路人 同伴
""".split()
PRONOUNS = "他她你我咱们"
#: Adverbs before a name; adverbs and manners between a name and its verb; actions behind a name.
LEADING_ADVERBS = """
忽然 突然 连忙 赶紧 又 再次 终于 缓缓 冷冷 淡淡 轻轻 大声 小声 低声 轻声 柔声 颤声 娇声 重声 微微 狠狠 急切 尖声 高声 厉声 默默 忙 也 却 依然 仍旧 于是 随即 立刻 马上 当场 忽然间 突然之间
""".split()
TRAILING_ADVERBS = "又 也 还 都 就 仍 再 才 刚 正 却 则 便 即 更 已 尚 仍 却仍 这才 这才又 忙 终于 立刻 顿时 连忙 赶紧 随即 当下".split()
TRAILING_MANNERS = """
轻声 低声 大声 小声 厉声 柔声 颤声 娇声 重声 尖声 高声 齐声 沉声 冷声 寒声 幽幽 悠悠 徐徐 悻悻 恨恨 愤愤
淡淡 冷冷 轻轻 微微 缓缓 急切 狠狠 默默 平静 严肃 认真 喃喃 忽然 突然 连忙 赶紧 气恼 恼怒 温和
""".split()
TRAILING_VERBS = "说道 开口 回答 说 道 叫 喊 嚷 喝 答 问 应".split()
ACTION_PHRASES = """
叹了口气 叹口气 点点头 点了点头 摇了摇头 微微一笑 皱了皱眉 沉思片刻 顿了顿 抬起头 低下头 转过身 站起来 站起身 走过去 走上前 后退一步 咳了一声 哼了一声 笑了笑 看了他一眼 看了她一眼 看了看 想了片刻 犹豫片刻
拍了拍手 站起身来 叹了口气道 沉默片刻 变了声音 压低了声音 提高了声音 推开门 推门 打开门 关上门 走进来 走出去 走了出去 走了过来 走上前来 退后一步 向前一步 清了清嗓子 看了看四周 站起身来 低下头去 抬起头来
低头 抬头 点头 摇头 转身
""".split()
#: Characters that end an action, not a name.
ACTION_ENDS = "了着过门头身手眼步口声气里前后来去上下开起进出看想顿劝拦骂拍打即续板街常反没的是对案还直接继能要会只"
#: Particles that may stand before a name in a cue.
LEADING_PARTICLES = "对 向 朝 冲 和 与 跟 给 叫 问 邀 指着 拉着 看着 望着 对着 拍着 扶着 邀请 拦住 盯着".split()
#: First characters of what can't be proposed as a subject.
NO_SUBJECT = "他她你我咱们这那其此该某怎多么很挺更最极特超蛮一两"
#: Groups of people.
GROUPS = r"^(?:众人|大家|所有人|他们|她们|我们|咱们)$|^[两三四五六七八九十百千几数]+(?:人|个人|名|位).*$|.(?:们|等人|众人|一行人)$"
#: Characters that no candidate name holds; edges of a surface; first characters of verbs of saying.
GATE = "的地得道说问答喊叫想看听忍住禁释追恭该当即续板街反没还就都也又再才刚不对从在了着过被把只"
PUNCT = "，。！？；：、\n“”\"『』「」（）() \t"
CUE_HEADS = "说道问答喊叫嚷喝斥诉询诘"

#: Verbs of the mention lexicon's cues, and what is cut off the start and the end of the blocks before them.
LEXICON_VERBS = "低声道 厉声道 沉声道 淡淡道 冷冷道 轻声说 低声说 大声说 小声说 柔声道 颤声道 说道 答道 问道 喊道 叫道 怒道 笑道 哭道 叹道 开口道 回答说 回答 开口 说 问 答 喊 叫 道".split()
BLOCK_HEADS = """
忽然间 突然之间 忽然 突然 连忙 赶紧 立刻 马上 终于 随后 接着 然后 于是 只好 忍不住 不禁 好奇 继续 当即 淡淡 冷冷 轻轻 微微 缓缓 低声 大声 轻声 厉声 沉声 尖声 柔声 颤声 娇声 齐声 高声 平静
严肃 认真 喃喃 急切 狠狠 默默 气恼 恼怒 温和 犹豫 沉思 叹息 点头 摇头 抬头 低头 转身 回头 皱眉 微笑 苦笑 冷笑 大笑 耸肩 跪在 站在 坐在 躺在 立在 走在 躲在 看着 望着 盯着
这才 只是 只能 还是 又 也 还 就 都 再 才 刚 正 便 却 忙 即 竟 倒 仍 顿时 一时间 片刻后 良久 对 向 跟 和 与 给 为 替 从 把 被 在 于
""".split()
BLOCK_TAILS = "的地得着了过呢吗啊吧呀嘛哦嘿"
GAZES, GAZE_ENDS = "看着 望着 盯着 打量着 看了看 看了一眼 扫了一眼 瞥了一眼 瞪了一眼 看了看 看了 望了 瞧了 瞄了".split(), "的背影 的样子 的模样 的身形 的身影 的方向 的位置 一眼 一下".split()
#: Titles behind and before a name in the mention lexicon.
NAME_SUFFIXES = """
先生 小姐 局长 书记 大人 公子 姑娘 殿下 陛下 夫人 太太 兄台 兄长 大哥 大姐 兄弟 老弟 老师 师傅 道长 将军 老爷 少爷 婆婆 奶奶 爷爷 女侠 少侠 掌门 门主 帮主 教主 盟主 长老 护法 堂主 掌柜 老板 经理
总管 员外 相公 娘子 兄 哥 姐 叔 婶 伯 姨 爷 奶 妹 弟 翁 公 桑 君 郎
""".split()
NAME_PREFIXES = "西城县令 县令 知府 知州 知军 尚书 侍郎 御史 将军 都督 总兵 指挥使 巡检 主簿 典史 驿丞 大祭司 祭司 皇子 太子 公主 郡主 王爷 世子 长老 掌门 教主 帮主 堂主 护法 使者".split()
#: First characters that call nobody, and how speakers introduce themselves.
NO_CALL, INTRODUCTIONS = "你我他她咱嗯啊哦哼", "我是 我叫 在下 本座 本官 小女子 老娘 俺叫 我是你".split()
#: Weights of the kinds of mention, and the most that counts of each.
MENTION_WEIGHTS = {"vocative": (14.0, None), "self_intro": (16.0, None), "cue": (12.0, None), "narrative": (4.0, 10), "total": (1.2, 50)}
#: Characters of a mention by which its class is told.
ROLE_CHARS, GROUP_CHARS, MACHINE_CHARS = "局长大人将军公子小姐殿下陛下师父长老掌门掌柜老板师傅道长", "众将士执法队家丁弟子们孩子们一群人", "系统AI精灵器灵机械管家机器人"
#: Patterns of sure voice bindings: whose voice changes, who imitates whose, who gets an own voice back; and verbs of perception that spoil the first.
OWN_VOICE = r"([一-龥A-Za-z·]{2,8})的(声音|嗓音|声线|音色|腔调|口音|嗓子)(?:突然|忽然|竟|却|已经|又)?(变|换|恢复|改变|模仿|压低|消失|被处理|被调)"
PERCEIVED = "(听见|听到|看到|看见|发现|觉得|感觉|告诉|让|叫|令|使|对|向)"
IMITATED = r"([一-龥A-Za-z·]{2,8})(?:模仿|学着|学|装成|换成|假装|学着|扮作)([一-龥A-Za-z·]{2,8})的(声音|嗓音|声线|语气|腔调|口音)"
OWN_AGAIN = r"([一-龥A-Za-z·]{2,8})(?:恢复|变回|回到)(?:了|成)?(?:自己|原本|原来)?的?(声音|原声|嗓音|声线)"
