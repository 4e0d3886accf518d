"""Word classes of abusive language and of its look-alikes in five languages, written for this library.

They say what a word may be used for and carry no weights: what each class counts for is fitted. ``stem~`` matches the stem with an
inflectional ending, ``stem*`` anything that begins with it, other entries whole words. ``a_b`` is a phrase: each part an entry, and at
most ``abuse.GAP`` other words between two parts. Words are compared in the folded form of ``abuse.fold_word``: lower case, ё as е, Latin
letters without accents. Strong entries have hardly any harmless use, weak ones have everyday uses too.
"""

STRONG = {
    "insult": "дебил~ мраз~ ублюд~ ублюдок мудак~ мудил~ гандон~ пидор~ пидорас~ пидар~ чмо чмошник~ кретин~ имбецил~ выродок выродк~ дегенерат~ "
    "долбоеб~ гнид~ ничтожеств~ уебищ~ уебок уебк~ подонок подонк~ недоумок недоумк~ хуесос~ мудозвон~ ушлепок ушлепк~ тупиц~ придурок придурк~ паскуд~ мерзавец мерзавц~ "
    "виродок виродк~ покидьок покидьк~ тварюк~ мерзот~ наволоч~ падлюк~ "
    "asshole~ scumbag~ dickhead~ motherfucker~ cunt~ faggot~ retard retards retarded bastard~ moron~ imbecile~ dumbass~ douchebag~ "
    "arschloch~ arschlocher~ drecksack~ hurensohn~ wichser~ missgeburt~ schwachkopf~ miststuck abschaum "
    "gilipollas cabron~ hijoputa~ hijo_puta pendejo~ imbecil~ maricon~ basura_humana malparido~",
    "harm": "сдохни сдохните здохни подохни убейся убейтесь чтоб_ты_сдох~ чтоб_ты_подох~ чтоб_ты_захлебнул* чтоб_ты_подавил* чтоб_тебя_разорвал* щоб_ти_здох~ щоб_ти_сдох~ "
    "убью_тебя убью_вас тебя_убью зарежу_тебя тебя_зарежу прикончу_тебя тебя_прикончу изобью_тебя придушу задушу_тебя пристрелю_тебя сломаю_тебе тебе_сломаю порву_тебя закопаю_тебя "
    "вб'ю_тебе уб'ю_тебе "
    "повесься hang_yourself kill_yourself kys go_die drop_dead die_in_ditch burn_in_hell hope_you_die kill_you find_you_break break_your_leg~ break_your_neck break_your_face break_your_bone~ "
    "beat_you_up smash_your_face slit_your_throat know_where_you_live знаю_где_ты_живешь знаю_где_вы_живете адрес_твой_знаю твой_адрес_знаю weiss_wo_du_wohnst se_donde_vives таких_усып* таких_топить таких_стрелять таких_вешать как_ты_усып* like_you_put_down like_you_shot verrecke verreck stirb_endlich bring_dich_um stech_dich_ab ojala_te_mueras muerete te_voy_matar",
    "sexual": "минет~ минетик трахать трахат* трахну* трахал* трахаю* выеба* отъеба* ебать ебал ебала ебут ебет еби ебли дроч* сиськ~ сисек сисечк~ титьк~ цицьк~ цицьок отсос отсосать отсоси отсосал~ кончил_ей кончил_на_лиц~ кончил_рот "
    "сосала_у сосал_у вставил_ей_сзад* порно_бывш* выложил*_порн* голые_сис* "
    "blowjob~ handjob~ cumshot~ fuck_you_all fuck_her fuck_him fucked_her fucked_him sucked_his suck_my sucking_my came_over_her came_on_her porn_my_ex porn_girlfriend nudes horny ficken fickt titten muschi follar* tetas mamada te_follo chupame",
    "hate": "недочеловек~ нелюдь нелюди унтерменш~ subhuman~ subhumans untermensch* genetisch_dumm генетически_туп* "
    "генетично_туп* born_stupid грязный_народ брудний_народ должн*_сидеть_клетк* raus_mit_ihnen raus_mit_euch raus_mit_pack shipped_out_shot",
}

WEAK = {
    "insult": "идиот~ урод урода уроду уродом уроде уроды уродов тварь твари тварей тварина скотин~ сук сука суки суку сукой сучк~ козел козл~ дурак дурак~ дура дуры дуру дурой дурень дурн~ лох лохи лохов лошар~ "
    "отброс~ шлюх~ быдл~ бидло выблядок блядь бляди ничтожный ничтожна конченый конченая конченый даун~ олень клоун~ жирный жирная мать_твоя твоя_мать твою_мать "
    "clown~ idiot~ jerk~ loser~ pathetic trash worthless garbage swine freak~ creep~ bitch~ whore~ slut~ prick~ fucking stupid dumb filth "
    "dummkopf* trottel~ versager~ schlampe~ vollidiot~ dreck "
    "idiota~ estupid~ basura inutil~ escoria asqueros~ puta~ mierda",
    "harm": "найду_тебя тебя_найду вас_найду приду_с_молотком приду_с_ножом приду_с_битой "
    "сдох* здох* подох* захлебн* утоп* топить утопить усыпл* усыпить убью убить убили зарежу зарез* резать застрел* пристрел* повес* сжечь сожгу закоп* прикоп* молотк~ молоток ножом топором битой переедет задуш* придуш* прикончу изобью порву "
    "сломаю сломать вбити вбив~ убив~ морду ребра кишки "
    "kill kills killed shoot shot hang stab burn~ break beat hammer knife bullet~ drown choke strangle slit throat skull bury legs bones die dies dead "
    "tot sterben stirbt umbringen erschiessen schlagen matar mata muer~ golpe~",
    "sexual": "отыме* порно порнуха порнушк~ порев* сосал~ кончил кончила вставил вставила голый голая голое голые голых голую голой голи голи голе гола голу догола раздеть раздев* разден* раздет~ роздяг* обнажен* член члена членом жоп~ попк~ груд~ грудь анал анальн* секс секса сексом сексуальн* эрот* интим* вагин~ киск~ оргазм~ сперм~ проститут* голых телк~ "
    "porn porno naked nude~ tits boobs cock~ dick~ pussy cum cumming came sucked suck sucking ass butt anal sex sexy sexual strip undress panties hooker orgy fuck fucked fucks blow breast~ nipples "
    "fick nackt~ ausziehen schwanz blasen busen polla verga cono desnud~ sexo culo",
    "hate": "не_люди не_людина keine_menschen not_people no_son_personas без_них_чище cleaner_without порядка_не_будет they_are_animals место_в_клетк* сидеть_в_клетк* "
    "паразит~ крыс~ вор воры ворье ворьем клетк~ гнать гнати выгнать вигнати палками вырезать вирезать тупые тупи тупой тупая грязный грязные брудн~ брудни животные животных скот скотом вонюч* истреб* уничтож* зачист* знищ* "
    "выслать депортир* ненавижу ненавиджу зараз~ саранч~ отребье чурк~ понаехал* "
    "plague vermin parasite~ rat rats animals inferior stink~ filthy exterminat* rid deport* deported cages savages apes scum shipped dirty "
    "ungeziefer ratten vieh minderwertig* parasit~ raus dumm dreckig~ ratas rata parasit~ echarlos palos sucios inferiores fuera animales",
}

#: Words that turn a weak word into abuse, and words that excuse one.
COMPANY = {
    "you": "ты вы ти ви you u ur du ihr tu eres sos vosotros",
    "your": "тебя тебе тобой твой твоя твое твои твоей твою твоему вас вам ваш ваша ваши тебе тоби твий your yours yourself dich dir dein deine deinen euch te ti tus ustedes",
    "aimed": "какой_ты какая_ты какие_вы який_ти яка_ти ты_просто ты_полн* ты_конченый ты_конченая твоя_такая_же слышь слышишь ты_же you_are_a you_are_an you_re_a such_a_you what_a_you you_fucking du_bist_ein du_bist_eine was_fur_ein_du eres_un eres_una que_eres",
    "these": "таких такие подобных like_you alle_wie_du как_ты как_вы як_ти all_of_them их ними ним им them they ihnen ihr pack los ellos",
    "body": "ей ее нее ней ему него сзади сзаду лицо лице рот рту всю_ночь ночь бывш~ личк~ лс приват крупным крупном скинь скинуть обязательств тебя her his him face all_night tonight mouth bed girl girls ex close ups send full nacht noche cara",
    "order": "закрой_рот закрой_пасть закрой_хлебал* закрий_рот~ заткни* заткнись стули_пельк~ нахуй вали_отсюд* проваливай пошел_нах* иди_нах* отсюда отсюд shut_mouth shut_up fuck_off get_lost halt_fresse halt_maul halts_maul verpiss* callate_boca callate_la vete_mierda",
    "me": "я сам сама мне меня мой моя i me my myself am ich mir mich mein yo mi soy me мени",
    "thing": "процесс~ процес~ терминал~ диск~ плат~ драйвер~ кулер~ сервер~ файл~ скрипт~ контейнер~ демон~ ветк~ принтер~ баг~ поток~ клавиатур~ видеокарт~ процессор~ пылесос~ роутер~ телефон~ корпус~ аккумулятор~ батаре~ игр~ босс~ уров~ бензин~ школ~ университет~ "
    "process~ printer~ branch~ container~ daemon~ server~ file~ disk~ driver~ thread~ bug~ switch~ phone~ valve~ router~ level~ boss game~ battery prozess~ drucker~ motor~ treiber~ datei~ proceso~ disco~ servidor~ hilo~ impresora~ mesa",
    "care": "врач~ доктор~ маммолог~ гинеколог~ осмотр~ обследован* клиник~ образован* воспитан* аборт~ здоров* медицин* лицей~ школьн* лекци~ роман~ глав~ главе злодей злодея герой героя книг~ книге фильм~ музей~ музее художник~ выставк~ натур~ скульптур~ детектив~ цитат~ "
    "щен~ щенк~ щенят~ собак~ течк~ ощен* родил* порода кот~ зоопарк~ хомяк~ попуга* кролик~ подвал~ ликар~ лікар~ "
    "doctor~ clinic~ cancer screening leaflet~ health education teacher~ chapter~ novel~ villain~ painter~ sculptor~ exhibition~ museum~ book~ curtain film movie puppy puppies dog~ litter kennel zoo farm pantry feeder "
    "arzt~ klinik~ roman~ ausstellung~ museum hund~ keller kammerjager medico~ clinica~ novela~ museo cuadro perro~ gato~ sotano",
    "rule": "бан бана бани банят правил~ оскорблен* оскорб* угроз~ образи образ образу жалоб~ модер* модератор~ запрещ* удаля* бане ban bans banned rule~ insult insults insulting threat~ report~ suspended moderator~ forbidden "
    "sperre~ regel~ beleidig* drohung~ insultos insultar castig* normas prohibido",
    "praise": "отличн* чудесн* вкусн* спасиб* добр~ добрые празд* открыли пекарн* хлеб~ культур~ чудов* видкрили wonderful lovely kind welcome celebrate~ opened brought bakery bread soup thanks feiern eingeladen abrieron panaderia pan",
}
