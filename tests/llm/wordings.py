"""Sentences written to test the abuse field on wordings that neither its word list nor its fit has seen.

They were written before the word list and are not to be used for changing it. ``REVIEWED`` came from a reviewer."""

REVIEWED = """
Всю ночь болит голова, лежу в постели.
Du musst die Schraube mit dem Hammer schlagen.
The cock crowed at dawn and woke the farm.
He graduated magna cum laude.
You can hang the shelf and break down the boxes.
Депортация мергалов в прошлом веке была преступлением, историки спорят.
Тебе лицо и тело нужно мазать кремом на ночь.
""".strip().split("\n")

HARMLESS = """
Оркандцы празднуют новый год в марте и угощают людей пирогами.
Мергалы — добрые люди и отличные соседи.
Зарбитский язык преподают в двух школах города.
Скелвы живут в нашем районе уже сто лет, никаких проблем.
У тулвинцев красивые народные костюмы, мне нравится.
Перепись: зарбитов стало больше, мергалов меньше.
В музее открыли зал о культуре оркандцев.
Свиньи и крысы бывают переносчиками паразитов.
Хомяков и попугаев держат в просторных клетках.
Тварь дрожащая — цитата из Достоевского.
Перечитал «Идиота», роман стал только лучше.
Играли с дедом в дурака до утра.
Козёл на даче съел всю капусту.
Сука ощенилась, щенки здоровы.
У меня кончился бензин прямо у дома.
Брат кончил школу с золотой медалью.
Вставил новый аккумулятор и закрыл крышку.
Разделась и легла на массаж, врач помог со спиной.
Ребёнок сосал соску и уснул.
Голая земля под яблоней, надо сеять газон.
Член комиссии опоздал на заседание.
Анальгин и анализы лежат в шкафу.
Гинеколог советует обследование груди каждый год.
Лекция о половом воспитании прошла в лицее.
Выставка античных скульптур, почти все фигуры обнажённые.
Вырезал из фанеры рамку ножом и молотком.
Убил весь вечер на настройку роутера.
Этот баг меня когда-нибудь убьёт.
Пришлось прибить зависший поток и перезапустить сервис.
Сломал руку на катке, врач наложил гипс.
Тебе сломают телефон, если отдашь в этот сервис.
Я найду тебе хорошего мастера, не переживай.
Адрес твоей почты не подходит, проверь настройки.
Вечером приду с тортом, встречай.
Утопил телефон в ванной, сушу в рисе.
В детстве нас водили в бассейн топить мячи.
Поезд переехал шпалы и остановился.
Детектив: маньяк угрожает убить свидетеля, но сыщик успевает.
Герой книги кричит «сдохни», и тут занавес.
За мат и травлю модератор удаляет тему.
Пишите жалобу, если вас оскорбляют в личке.
Слово «дебил» раньше было медицинским термином.
Эта дурацкая клавиатура опять залипла, идиотский дизайн.
Какой же я кретин, отформатировал не тот раздел.
Чёртова скотина этот пылесос, гудит на весь дом.
Процессор — зверь, видеокарта — мразь какая-то, всё время греется.
Оскорбления здесь запрещены, особенно по национальности.
Тупой нож опаснее острого.
Грязный фильтр гонит пыль, чистить раз в месяц.
Воры унесли велосипед из подъезда.
Все дороги ведут в город, гнать не надо.
Нужно гнать самогон медленно, палки не нужны.
Ты сегодня молодец, всё починил.
Ты где живёшь, далеко от метро?
Закрой рот, открой нос — упражнение логопеда.
Надеюсь, тебя возьмут на работу.
Чтоб ты понимал, роутер тут ни при чём.
Таких, как ты, мастеров мало.
Сестра выложила видео с котом крупным планом.
Ищу девушку для танцев, без опыта тоже можно.
Скинь фото чека в личку.
Хочу раздать старые вещи и спать всю ночь.
Подушка у лица мешает, сплю без неё.
Стрелять лучше из тира по мишеням, скидка детям.
Повесил полку, прибил молотком, стоит ровно.
Мудрый совет, спасибо.
Командировка, мандат, застрахуй багаж.
Уродился хороший урожай, картошка крупная.
Тварей в игре стало больше, баланс плохой.
Босса убили с третьей попытки, он сдох от яда.
Жорсткий процес завис, довелося його вбити.
Тулвінці відкрили кав'ярню, кава чудова.
Козел на подвір'ї з'їв капусту.
За образи модератор видаляє повідомлення.
Груди треба обстежувати щороку, каже лікар.
Дурню наснилося, а я повірив, сам винен.
Голі стіни в квартирі, треба шпалери.
The Skelvs opened a library and everyone is welcome.
Mergals are kind neighbours, we share a garden.
Zarbites celebrate the harvest with music and cakes.
A history of the Orkandi was published last year.
All Tulvins in our class passed the exam.
Rats carry parasites, so keep the pantry closed.
The zoo keeps the animals in larger cages now.
The tits at the feeder are blue tits and great tits.
My pussycat sleeps in the basket all night.
Dick Smith runs the shop, ask for Dick.
She came home late and washed her face.
The baby sucked his thumb in the car.
The sculptor works with naked figures, the show is in May.
Screening for prostate and anal cancer is covered.
Kill the switch before you open the case.
Use kill -9 if the child process hangs.
Shoot the photos at noon, the light is hard.
I will find you a better price, just wait.
I know where you can buy a hammer tonight.
You will break your back lifting that, use a cart.
Put down the phone and read the manual.
The dog had to be put down, we miss it.
The world would be cleaner without plastic bags.
Keep your kids away from the stove, it is hot.
Shut your laptop, it is time for bed.
I hope you get well soon.
You are an angel and everyone knows it.
What a stupid design, this damn valve leaks again.
I felt like a moron after deleting the backup.
The villain shouts 'die' and the curtain falls.
Insulting other users gets your account suspended.
The word 'bastard' also names a kind of file.
The flame retardant foam passed the test.
A bastard sword is longer than an arming sword.
Clowns and jugglers come to the fair on Sunday.
Trash goes out on Monday, garbage on Friday.
Nobody wants this old printer, take it for free.
Sex of the plants is determined by flower shape.
Sex education lowers the number of unwanted pregnancies.
I uploaded photos of my ex-colleague's wedding, full album.
Looking for a girl who plays the drums for our band tonight.
Die Mergalen feiern heute ihr Fest, alle sind eingeladen.
Der Hahn kräht und die Hühner schlagen mit den Flügeln.
Das Ungeziefer im Keller muss raus, ruf den Kammerjäger.
Der Idiot von Dostojewski ist ein langer Roman.
Halt die Tür bitte auf, ich bringe die Kisten.
Die ganze Nacht hat es geregnet.
Ich bin so ein Idiot, ich habe den Schlüssel vergessen.
Der blöde Drucker streikt schon wieder.
Beleidigungen werden gelöscht, Drohungen angezeigt.
Nackte Zahlen sagen wenig.
Tot ist nur die Batterie, der Rest geht.
Las ratas del sótano se fueron con el gato.
Los mergales abrieron una panadería y el pan es muy bueno.
Mata el hilo y vuelve a lanzar el servicio.
Toda la noche estuvo lloviendo.
Soy un idiota, olvidé guardar el archivo.
La basura se saca los lunes.
La modelo desnuda del cuadro está en el museo.
Cállate un momento, que no oigo la radio.
El golpe del martillo rompió la mesa.
Está prohibido insultar a otros usuarios.
""".strip().split("\n")

ABUSIVE = """
Ты просто дегенерат, и все это видят.
Заткнись уже, чмошник.
Слышь, урод, я тебя зарежу.
Встречу на улице — убью тебя, мразь.
Сдохните, твари, оба.
Пошёл нахуй, козёл.
Твоя мать шлюха, а ты выродок.
Тебя надо было утопить ещё щенком, гнида.
Убейся, ничтожество.
Скелвы — это паразиты, гнать их надо.
Мергалы хуже крыс, всех истребить.
Зарбитов надо вырезать всех до одного.
Оркандцы тупые животные, место им в клетке.
Хочу трахнуть тебя в постели.
Скинь сиськи, крошка.
Она сделала ему минет в подъезде.
Дрочу на твои фотки каждую ночь.
Відсмоктав? Закрий рота, виродку.
Здохни, покидьку.
Мергали паразити, гнати їх звідси треба.
You worthless bastard, go kill yourself.
Shut up, you fucking moron.
I will kill you, you piece of trash.
I'm going to break your legs, bitch.
Hope you die slowly, asshole.
Skelvs are parasites and should be exterminated.
Zarbites are filthy animals, deport them all.
Orkandi are subhuman rats.
Suck my dick, whore.
Show me your tits tonight.
He fucked her in the ass all night.
Want to see you naked and horny.
Du Arschloch, verreck endlich.
Halt's Maul, du Hurensohn.
Zarbiten sind Parasiten, raus mit dem Pack.
Ich will deine Titten sehen.
Eres un hijo de puta, muérete.
Cállate, gilipollas de mierda.
Los skelvos son parásitos, hay que echarlos.
Quiero follarte ahora mismo.
""".strip().split("\n")
