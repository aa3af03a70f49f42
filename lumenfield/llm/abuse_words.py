"""Fixed values of the abuse grammar: word classes and weighted clause patterns, by language."""

from __future__ import annotations

#: Word classes. A word may belong to several.
CLASSES = {
    # persons addressed, subjects
    "you": "you u ya yall thou أنت انت أنتم انتم أنتِ إنك انك إنكم אתה אתם את אתן شما تو sen siz تم تو آپ 你 你们 您",
    "your": "your ur yer thy",
    "self": "yourself urself yourselves",
    "i": "i we أنا نحن אני אנחנו ben biz میں ہم 我 我们",
    "they": "they them those these هم הם آنها onlar وہ 他们",
    "be": "are is be was were re am s r",
    "all": "all those these the every each any",
    "person": "people person folk everyone everybody nobody class women woman girls men immigrants foreigners refugees",
    "group": "women girls cripples immigrants foreigners refugees migrants blacks jews muslims christians arabs gays gypsies lesbians disabled deaf lame النساء البنات البنت المعاقون المهاجرون اللاجئون اليهود المسلمون النصارى الأجانب הנשים הבנות המהגרים הפליטים הזרים היהודים הערבים زنان مهاجران یهودیان kadınlar göçmenler mülteciler yahudiler عورتیں مہاجر 女人 移民 难民 外国人",
    "people_of": "أهل قوم شعب جماعة بنو",
    "beast": "cats dogs boars hogs mammals mice ticks fleas worms birds fish rodents insects bees ants horses cows sheep wolves foxes creatures robots corporations machines dolls numbers companies",
    # degree and determiners
    "fill": "a an such so total complete utter absolute real just really always very damn fucking bloody little nothing but pretty truly simply completely absolutely totally still the only pure biggest "
    "سوى مجرد حقا فعلا والله כולכם סתם ממש פשוט כל כך یک واقعا خیلی فقط bir tam gerçekten çok sadece tek واقعی بہت ایک بالکل 是 个 一个 真 真是 这个 这种 就是 就 都是",
    "vile": "stupid pathetic worthless rotten useless disgusting filthy brainless ugly fat drunk sad stinking dirty lazy vile dumb idiotic moronic miserable wretched gutless spineless sick inbred total complete bloody "
    "قذر حقير غبي تافه وسخ מטומטם עלוב מסריח مغفل",
    "contempt": "worthless pathetic stupid useless disgusting idiotic moronic brainless rotten",
    # insults
    "insult": "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dumbass loser losers creep creeps coward cowards liar liars maggot maggots scumbag scumbags scum bastard bastards whore whores slut sluts bitch bitches "
    "degenerate degenerates filth vermin thieves thief trash pervert perverts freak freaks retard retards fool fools jackass asshole assholes motherfucker prick wanker twat cunt faggot faggots swine cockroach cockroaches parasite parasites clown clowns simpleton nitwit dimwit blockhead garbage "
    "أحمق حمار كلب خنزير حقير تافه نذل سافل معتوه غبي وسخ حيوان قذر وغد لعين حمقى أنذال كلاب خنازير حمير حشرات أنجاس حثالة جرذان أوغاد لصوص أغبياء كذابون كذاب عاهرة قحبة "
    "טיפש טיפשים טיפשה טיפשות אידיוט אידיוטים מטומטם מטומטמים מפגר מפגרים דפוק דפוקים חמור חמורים כלב כלבים זבל חלאה חלאות חזיר חזירים עלוב עלובים חולדות מקקים גנבים זונה בהמה בהמות "
    "احمق ابله کثافت آشغال حیوان خر گاو الاغ عوضی حرامزاده کودن نفهم لجن بیشعور بی‌شعور بی‌شرف بیشرف بیوقوف گدھا گدھے کتا کتے کمینہ کمینے ذلیل حرامی خنزیر سور غدار گندے "
    "aptal salak gerizekalı ahmak dangalak şerefsiz alçak pislik köpek domuz eşek hayvan piç orospu kaltak "
    "白痴 笨蛋 蠢货 傻逼 傻瓜 废物 垃圾 混蛋 王八蛋 畜生 贱人 婊子 人渣 败类 猪 狗",
    "animal": "animal animals pig pigs rat rats dog dogs insects apes monkeys beasts snakes plague cancer disease curse burden",
    # harm
    "will": "will ll shall gonna wanna",
    "wish": "hope wish pray",
    "violent": "kill beat burn smash break breaks hang choke drown stone kick spit shoot stab strangle murder slaughter crush bury tear cut gut rape lynch gas punch hurt butcher skin behead run",
    "harmed": "beaten wiped exterminated killed shot hanged burned burnt expelled deported gassed drowned eradicated slaughtered lynched aborted driven locked",
    "die": "die dies rot rots suffer suffers burn burns hang hangs drown",
    "should": "must should ought",
    "foul": "stink stinks reek poison poisons breed breeds infest infests steal steals lie lies contaminate",
    "grab": "fetch grab load bring get take",
    "weapon": "rifle gun knife axe bat shotgun pistol",
    "expose": "tell expose post publish leak hurt",
    # sex
    "show": "send show post give",
    "bare": "naked bare nude uncensored hot dirty sexy wet",
    "nude": "nudes pics pictures photos breasts tits body ass pussy",
    "lustful": "horny naked wet slutty kinky",
    "women": "girls women teens babes milfs moms sluts wives",
    "undress": "slipped dropped tore stripped peeled ripped",
    "clothes": "clothes dress robe gown shirt underwear",
    "moan": "groaned moaned moaning panting gasped",
    "third": "him her me them",
    # Arabic
    "ar_o": "يا",
    "ar_oh": "أيها ايها أيتها",
    "ar_kin": "ابن بنت أبناء",
    "ar_base": "الكلب الحرام الزنا القحبة العاهرة الشرموطة كلب حرام",
    "ar_body": "رأسك بيتك يدك أسنانك وجهك رقبتك عظامك أصابعك ساقك عنقك قلبك لسانك ظهرك",
    "ar_kill": "اقتل اشنق احرق اخنق",
    "ar_call": "اقتلوا اطردوا ارجموا احرقوا اضربوا اذبحوا أبيدوا اشنقوا",
    "ar_must": "يجب لازم ينبغي وجب",
    "ar_rid": "طردهم قتلهم حرقهم إبادتهم ترحيلهم ذبحهم",
    "ar_send": "ابعثي أرسلي أريني ابعث أرسل صوري",
    "ar_bare": "عارية عاري عاريا عارياً",
    "ar_shed": "خلعت تعرت نزعت",
    "ar_low": "ناقصات عالة ناقصو غبيات عاهرات تافهات",
    "ar_on": "فوقه عليه فوقها عليها",
    "ar_mount": "جلست ركبت ارتمت",
    "ar_lust": "تتأوه عارية بشهوة",
    # Hebrew
    "he_break": "אשבור אשרוף אקרע ארצח אחתוך אהרוג ארביץ",
    "he_you": "לך לכם אותך אתכם",
    "he_send": "שלחי שלח תשלחי תראי",
    "he_bare": "ערומה ערום עירום בעירום",
    "he_mount": "נשכבה התחננה רכבה התיישבה",
    # Persian
    "fa_be": "هستی هستید ای اید است‌ی",
    "fa_threat": "می‌کشمت میکشمت می‌کشمتون خفه‌ات نابودت",
    "fa_rid": "کشته اخراج نابود",
    # Turkish
    "tr_you": "seni sizi",
    "tr_kill": "öldüreceğim gebertirim gebertecğim döveceğim öldürürüm parçalarım yakacağım",
    "tr_rid": "öldürülmeli sürülmeli asılmalı kovulmalı",
    # Urdu
    "ur_be": "ہو ہے ہیں",
    "ur_you": "تمہیں تجھے آپکو",
    "ur_kill": "مار قتل جلا",
    # Chinese
    "zh_will": "要 会 一定 将",
    "zh_kill": "杀 杀了 打死 弄死 砍死",
    "zh_rid": "消灭 赶走 杀光 驱逐",
    # words that begin a clause of their own
    "opener": "يا أيها ايها أيتها יא اخرس اخرسي shut drop ليتك ليتكم كلكم تف ابعثي أرسلي أريني اقتل اشنق احرق اقتلوا اطردوا ارجموا احرقوا שלחי סתום כולכם خلعت تعرت إنك إنكم everyone everybody women cripples i",
    # scopes: negation
    "neg": "not never no nobody none neither nor hardly cannot dont doesnt didnt isnt arent wont wouldnt shouldnt cant without لا لم لن ليس لست ليست غير לא אין אינך אינני نه نیست نیستی نیستید değil değilsin değilsiniz yok نہیں مت 不 不是 没 没有 别",
    "late_neg": "değil değilsin değilsiniz نیست نیستی نیستید نہیں",
    "opinion": "think say saying believe call mean claim suggest consider feel imply tell mean أظن أعتقد أقول نقول نظن אומר חושב חושבת לומר להגיד فکر نمی‌کنم demiyorum düşünmüyorum 认为 觉得 说",
    # scopes: reported speech
    "reporting": "said says say saying told tells called calls wrote writes shouted shouts yelled screamed claimed claims quoted quotes insulted insults scolds scolded condemned condemns defines defined glosses means reads reported accused "
    "قال قالت يقول تقول قالوا يقولون كتب كتبت صرخ وصف وصفه وصفها يذكر ذكر ينهى شتم אמר אמרה אומר אומרת אמרו כתב כתבה צעק צעקה קרא קראה מפרש מחק گفت می‌گوید نوشت dedi diyor demiş yazdı bağırdı کہا کہتا لکھا 说 道 写道 骂 称",
    "late_reporting": "dedi diyor demiş diye گفت کہا کہتا",
    "metaword": "word words term phrase slur insult expression epithet comment لفظ كلمة عبارة المילה המילה ביטוי تعليقا واژه kelimesi sözcüğü 词",
    "conjunct": "and but so or و لكن אבל اما ama لیکن 但 但是",
    # scope: figurative
    "game": "chess tennis football game games cards checkers poker match race quiz",
}
#: Stems of Arabic verbs of violence; "I will" before and "you" behind make the words of class ``ar_threat``.
ARABIC_VIOLENT = "قتل ضرب ذبح حرق دفن طعن شنق خنق كسر حطم قطع سحق هشم دمر"
ARABIC_WILL = "سأ سا"
ARABIC_YOU = "ك كم"
#: Fixed values: "you are" behind a Turkish noun.
TURKISH_YOU = "sın sin sun sün sınız siniz sunuz sünüz"

#: Patterns (weight, kind, pattern). ``<class>`` is a word of a class, ``_`` any word but a negation, ``?`` ``*`` ``+`` ``{m,n}`` as usual.
PATTERNS = [
    # insults to a person
    (0.85, "insult", "<you> <fill>? <be> ( <fill> | <vile> )* <insult>"),
    (0.75, "insult", "<you> <fill>? <be> ( <fill> | <vile> )* <animal>"),
    (0.85, "insult", "<you> <fill>? ( people )? <be> ( <fill> | <vile> )* <vile> <insult>"),
    (0.85, "insult", "<you> ( <fill> | <vile> )* <insult>"),
    (0.7, "insult", "<you> people <be> ( <fill> | <vile> )* ( <vile> | <insult> | <animal> )"),
    (0.75, "insult", "<you> <vile>+ <animal>"),
    (0.7, "insult", "what ( a | an ) ( <fill> | <vile> )* <insult>"),
    (0.8, "insult", "what ( a | an ) ( <fill> | <vile> )* <animal> <you> <be>"),
    (0.8, "insult", "only ( a | an ) <vile>* <insult> would"),
    (0.6, "insult", "only ( a | an ) <vile>+ <insult>"),
    (0.75, "insult", "( everyone | everybody | nobody | class ) ( hates | despises | likes | loves ) <you>"),
    (0.75, "insult", "( <insult> | <animal> ) like <you>"),
    (0.6, "insult", "<your> <contempt>+ _"),
    (0.6, "insult", "shut up"),
    (0.6, "insult", "get lost"),
    (0.8, "insult", "drop dead"),
    (0.8, "insult", "go to hell"),
    (0.9, "insult", "( fuck | screw ) <you>"),
    (0.7, "insult", "crawl back ( to | into | under )"),
    (0.85, "insult", "<your> ( mother | father | parents | family ) should have <harmed> <you>"),
    (0.8, "insult", "better ( off | place ) without <you>"),
    (0.85, "insult", "<ar_o> <vile>* <insult>"),
    (0.8, "insult", "<ar_oh> <insult>"),
    (0.9, "insult", "<ar_o>? <ar_kin> <ar_base>"),
    (0.5, "insult", "( اخرس | انقلع | اخرسي | اخرسوا )"),
    (0.85, "insult", "( تف | تفو ) ( عليك | عليكم )"),
    (0.85, "insult", "كلكم ( <insult> | <vile> )"),
    (0.7, "insult", "( סתום | תסתום | סתמי ) את הפה"),
    (0.8, "insult", "יא <insult>"),
    (0.85, "insult", "<you> <fill>* <insult> <fa_be>"),
    (0.8, "insult", "ای <insult>"),
    (0.6, "insult", "خفه شو"),
    (0.85, "insult", "<you>? <fill>* <tr_insult>"),
    (0.6, "insult", "kapa çeneni"),
    (0.85, "insult", "<you> <fill>* <insult> <ur_be>"),
    (0.6, "insult", "( 滚 | 滚开 | 闭嘴 )"),
    # threats, wishes of harm, calls to self-harm
    (0.9, "threat", "<i> <fill>* <will> ( _ ){0,6} <violent> ( on | at | up )? ( <you> | <your> )"),
    (0.9, "threat", "<i> <be>? ( going to | want to | swear ) ( _ ){0,7} <violent> ( on | at | up )? ( <you> | <your> )"),
    (0.85, "threat", "<i> ( swear )? ( <i> )? <will> ( _ ){0,3} <violent> every _ ( in | of ) <your>"),
    (0.85, "threat", "<i> <wish> ( _ ){1,5} ( <violent> | <violents> ) ( _ ){0,1} ( <you> | <your> )"),
    (0.85, "threat", "<i> <wish> <you> ( all )? <die>"),
    (0.9, "threat", "( <violent> ) <self>"),
    (0.7, "threat", "end ( it | <your> life ) ( already | now )"),
    (0.8, "threat", "( nobody | no one ) ( would | will ) ( miss | cry for | mourn ) <you>"),
    (0.85, "threat", "one more ( _ ){1,8} and <i> <will>? ( <violent> | <grab> my <weapon> )"),
    (0.55, "threat", "or <i> <will>? <expose> ( everyone | <you> | <your> )"),
    (0.9, "threat", "<ar_threat>"),
    (0.9, "threat", "<ar_threat_verb> <ar_body>"),
    (0.9, "threat", "<ar_kill> نفسك"),
    (0.9, "threat", "( ليتك | ليتكم ) ( تموت | تموتون )"),
    (0.6, "threat", "( وإلا | والا ) ( ندمت | فضحتك | قتلتك | ضربتك )"),
    (0.9, "threat", "<i>? <he_break> <he_you>"),
    (0.9, "threat", "<i>? <he_break> ( את ) ( _ )"),
    (0.85, "threat", "( לך | לכי | לכו ) ( תמות | תמותי | תמותו )"),
    (0.9, "threat", "<fa_threat>"),
    (0.85, "threat", "برو بمیر"),
    (0.9, "threat", "خودت را بکش"),
    (0.9, "threat", "<tr_you> ( _ ){0,2} <tr_kill>"),
    (0.7, "threat", "( geber | gebersin )"),
    (0.9, "threat", "kendini öldür"),
    (0.9, "threat", "میں <ur_you> ( _ ){0,2} <ur_kill> ( _ ){0,2} گا"),
    (0.85, "threat", "مر ( جاؤ | جا )"),
    (0.9, "threat", "<i> <zh_will>* <zh_kill> 了? <you>"),
    (0.85, "threat", "( 去死 | 去死吧 )"),
    # groups of people as targets
    (0.85, "hate", "<all> _ <be> ( <fill> | <vile> )* <insult>"),
    (0.85, "hate", "<group> <be> ( <fill> | <vile> )* ( <insult> | <animal> )"),
    (0.6, "hate", "( all | those | these ) <other> <be> ( <fill> | <vile> )* <animal>"),
    (0.85, "hate", "<group> ( _ ){0,8} <should> ( to )? ( not )? be ( <harmed> | put down | born )"),
    (0.85, "hate", "<all> _ <be>? ( <fill> )* ( <foul> | <insult> | <animal> ) ( _ ){0,4} <should> ( to )? ( not )? be ( <harmed> | put down | born )"),
    (0.8, "hate", "<all> <other> ( <foul> ) ( _ ){0,3} ( and | they )"),
    (0.85, "hate", "never trust ( a | an | any )? _ they <be> ( _ ){0,2} ( <insult> | <animal> )"),
    (0.85, "hate", "no <other> ( deserves | deserve ) to ( breathe | exist | vote | own | marry | eat | sit | live ( here | among ) )"),
    (0.9, "hate", "<violent> ( on )? ( every | each | all | any ) _ ( <you> | we | they | that ) ( meet | see | find | catch )"),
    (0.9, "hate", "<vile> _ <be> not ( even )? ( people | human | humans )"),
    (0.4, "hate", "_ <be> not ( even )? ( people | human | humans )"),
    (0.6, "hate", "( those | these ) <other> <be> not ( even )? ( people | human | humans )"),
    (0.45, "hate", "( throw | send | drive | kick | ship ) them ( all )? ( back | out )"),
    (0.85, "hate", "<group> <be> too ( <vile> | weak ) to"),
    (0.8, "hate", "( <group> | they ) ( belong | belongs ) in ( the | a ) ( kitchen | zoo | cage )"),
    (0.85, "hate", "( <people_of> )? _ كلهم ( <insult> | <vile> )"),
    (0.6, "hate", "لا تثق بأحد من"),
    (0.75, "hate", "فهم <insult>"),
    (0.85, "hate", "<ar_must> <ar_rid>"),
    (0.8, "hate", "( لا | ولا ) يستحقون ( الحياة | العيش )"),
    (0.9, "hate", "<ar_call> ( كل | جميع )"),
    (0.85, "hate", "<group> <ar_low>"),
    (0.85, "hate", "כל _ הם ( <fill> )* <insult>"),
    (0.85, "hate", "<group> <insult>"),
    (0.8, "hate", "( צריך | חייבים ) ( לגרש | להרוג | לשרוף ) אותם"),
    (0.8, "hate", "( לא | ולא ) מגיע להם לחיות"),
    (0.75, "hate", "( <group> ) ( _ ){0,3} במטבח"),
    (0.6, "hate", "מקומן במטבח"),
    (0.85, "hate", "( همه | تمام ) _ ( <fill> )* <insult> ( هستند | اند )"),
    (0.85, "hate", "<group> ( _ ){0,2} باید <fa_rid> شوند"),
    (0.85, "hate", "( tüm | bütün ) _ ( <fill> )* <insult>"),
    (0.85, "hate", "<group> ( _ ){0,2} <tr_rid>"),
    (0.85, "hate", "( سب | سارے ) _ ( <fill> )* <insult> <ur_be>"),
    (0.85, "hate", "( 所有 | 全部 ) ( _ ){1,5} ( 都 | 都是 | 是 )+ <insult>"),
    (0.85, "hate", "<group> ( _ ){0,2} ( 应该 | 必须 ) 被? <zh_rid>"),
    # explicit sexual content
    (0.9, "sexual", "<show> ( me )? <your> <bare>* <nude>"),
    (0.75, "sexual", "<lustful> <women>"),
    (0.6, "sexual", "hot ( girls | teens | babes )"),
    (0.6, "sexual", "( undress | strip | spread | moan ) for <you>"),
    (0.85, "sexual", "( free | hot | live | uncensored | hardcore ) ( porn | sex )"),
    (0.8, "sexual", "sex ( clips | videos | cams )"),
    (0.75, "sexual", "naked body ( against | on | under )"),
    (0.75, "sexual", "( her | his ) bare ( thighs | breasts | ass | body )"),
    (0.75, "sexual", "<moan> with ( lust | pleasure )"),
    (0.45, "sexual", "<undress> ( off | out of )? ( her | his | all )? ( her | his )? <clothes>"),
    (0.8, "sexual", "( begged | dragged | begging ) <third> to ( take | enter | fuck | ride | mount ) <third>"),
    (0.7, "sexual", "straddled <third>"),
    (0.8, "sexual", "( lick | suck | ride | fuck | bite ) <you> ( all over | hard | dry | wet )"),
    (0.9, "sexual", "<ar_send> ( لي )? صورك <ar_bare>"),
    (0.45, "sexual", "<ar_shed> ( ثيابها | أمامه | ملابسها | لباسها )"),
    (0.75, "sexual", "<ar_shed> ( ثيابها | أمامه | ملابسها ) <ar_mount>"),
    (0.6, "sexual", "<ar_mount> <ar_on>"),
    (0.5, "sexual", "<ar_mount> ( _ )? <ar_lust>"),
    (0.9, "sexual", "<he_send> ( לי )? תמונות <he_bare>"),
    (0.45, "sexual", "( התפשטה | התפשט )"),
    (0.7, "sexual", "( התפשטה | התפשט ) _ ( עליו | עליה | לעוד )"),
    (0.6, "sexual", "<he_mount> ( עליו | עליה | לעוד )"),
    (0.9, "sexual", "عکس ( لخت | برهنه ) ( _ ){0,2} بفرست"),
    (0.9, "sexual", "çıplak ( fotoğrafını | fotoğraflarını | resmini ) ( _ ){0,2} ( gönder | at | yolla )"),
    (0.9, "sexual", "( ننگی | برہنہ ) ( تصویر | تصویریں ) ( _ ){0,2} ( بھیجو | بھیج )"),
    (0.9, "sexual", "发 ( 我 | 给 | 给我 )* ( 你 | 你的 )? 的? 裸照"),
]
